"""Similarity search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens.operators import neighbours as N
from arealens.operators.scaling import zscore
from arealens.operators.spatial import nearest_facility
from arealens.plans.search import city_neighbours, find_neighbours, unit_by_name


def brute(points, k):
    """{id: [(neighbour, distance)]} by (distance, id), the point itself left out."""
    out = {}
    for i, p in points.items():
        others = sorted((float(np.sqrt(((q - p) ** 2).sum())), j) for j, q in points.items() if j != i)
        out[i] = [(j, d) for d, j in others[:k]]
    return out


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["neighbour_id"], r["distance"]))
    return out


def same(got, wanted):
    assert got.keys() == wanted.keys()
    for key in wanted:
        assert [n for n, _ in got[key]] == [n for n, _ in wanted[key]], key
        assert [d for _, d in got[key]] == pytest.approx([d for _, d in wanted[key]], abs=1e-9)


def clustered(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=20, size=(6, dims))
    points = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dims))
    points[: n // 3] = points[0]  # a third of the rows are one and the same point
    return {i: points[i] for i in range(n)}


def frame(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in points.items()], "id long, v array<double>")


def test_a_query_is_sent_once_per_lot_of_balls(spark, monkeypatch):
    # in many dimensions nearly all balls are visited; a query must not travel to each of them
    rng = np.random.default_rng(5)
    points = {i: p for i, p in enumerate(rng.normal(size=(400, 24)))}
    sent = []
    visit = N._visit
    monkeypatch.setattr(N, "PIECE_REFS", 150)
    monkeypatch.setattr(N, "ROUTE_CELLS", 100)
    monkeypatch.setattr(N, "_visit", lambda routed, *rest, **how: (sent.append(routed), visit(routed, *rest, **how))[1])
    found = as_dict(N.knn(frame(spark, points), "id", "v", 4, strategy="balls", include_self=False))
    same(found, brute(points, 4))
    assert max(s.count() for s in sent) <= 400 * 4


def test_distances_to_pivots_are_held_in_slices(spark, monkeypatch):
    # a batch of vectors by all pivots at once would grow with the number of pivots
    cells, plain = 3000, N._distances

    def checked(a, b):
        assert len(a) * len(b) <= cells, f"{len(a)} x {len(b)} distances at once"
        return plain(a, b)

    points = {i: p for i, p in enumerate(np.random.default_rng(7).normal(size=(900, 3)))}
    wanted = brute(points, 3)
    monkeypatch.setattr(N, "ROUTE_CELLS", cells, raising=False)
    monkeypatch.setattr(N, "_distances", checked)
    one_batch = frame(spark, points).coalesce(1)
    same(as_dict(N.knn(one_batch, "id", "v", 3, strategy="balls", include_self=False)), wanted)
    probed = N.knn(one_batch, "id", "v", 3, strategy="balls", include_self=False, probe=2)
    assert {len(found) for found in as_dict(probed).values()} == {3}


def test_lots_hold_a_bounded_number_of_vectors(monkeypatch):
    monkeypatch.setattr(N, "PIECE_REFS", 100)
    rng = np.random.default_rng(6)
    size = rng.integers(0, 40, 60)
    size[7] = 230
    places = rng.normal(size=(60, 2))
    pieces = np.maximum(1, -(-size // 100))
    gaps = np.sqrt(((places[:, None] - places[None, :]) ** 2).sum(-1))
    lot = N._lots(size, pieces, gaps)
    share = np.repeat(size / pieces, pieces)
    assert lot.min() == 0 and np.bincount(lot, weights=share).max() <= 100
    assert lot.max() + 1 <= 2 * size.sum() / 100 + 2


@pytest.mark.parametrize("strategy", ["small", "balls"])
@pytest.mark.parametrize("dims,k", [(2, 1), (3, 5), (12, 4)])
def test_exact_with_copies_and_clusters(spark, monkeypatch, strategy, dims, k):
    # small pieces, so that balls are cut and queries are spread
    monkeypatch.setattr(N, "PIECE_REFS", 7)
    monkeypatch.setattr(N, "PIECE_QUERIES", 10)
    points = clustered(dims, 240, dims)
    got = N.knn(frame(spark, points), "id", "v", k, include_self=False, strategy=strategy)
    same(as_dict(got), brute(points, k))


@pytest.mark.parametrize("strategy", ["small", "balls"])
def test_self_comes_first(spark, strategy):
    points = clustered(9, 60, 2)
    got = as_dict(N.knn(frame(spark, points), "id", "v", 3, strategy=strategy))
    assert all(rows[0] == (key, 0.0) and len(rows) == 4 for key, rows in got.items())


@pytest.mark.parametrize("strategy", ["small", "balls"])
def test_two_tables_with_text_ids(spark, strategy):
    rng = np.random.default_rng(3)
    q, r = rng.normal(size=(50, 2)), rng.normal(size=(80, 2))
    queries = spark.createDataFrame([(f"q{i}", float(a), float(b)) for i, (a, b) in enumerate(q)], "id string, x double, y double")
    refs = spark.createDataFrame([(f"r{i}", float(a), float(b)) for i, (a, b) in enumerate(r)], "rid string, x double, y double")
    got = as_dict(N.knn(queries, "id", ["x", "y"], 2, refs, "rid", strategy=strategy))
    for i, p in enumerate(q):
        d = np.sqrt(((r - p) ** 2).sum(axis=1))
        best = sorted((d[j], f"r{j}") for j in range(80))[:2]
        assert [n for n, _ in got[f"q{i}"]] == [n for _, n in best]


def test_fewer_rows_than_neighbours(spark):
    points = {0: np.array([0.0]), 1: np.array([1.0])}
    for strategy in ("small", "balls"):
        got = as_dict(N.knn(frame(spark, points), "id", "v", 5, strategy=strategy))
        assert {k: len(v) for k, v in got.items()} == {0: 2, 1: 2}


def test_rows_with_missing_features_are_left_out(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 2.0), (3, 3.0, 3.0)], "id int, a double, b double")
    got = as_dict(N.knn(df, "id", ["a", "b"], 2))
    assert set(got) == {1, 3} and len(got[1]) == 2


def test_size_limit_of_the_small_way(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL_REFS", 10)
    points = {i: np.array([float(i)]) for i in range(30)}
    with pytest.raises(ValueError):
        N.knn(frame(spark, points), "id", "v", 2, strategy="small")
    same(as_dict(N.knn(frame(spark, points), "id", "v", 2, include_self=False)), brute(points, 2))


def test_one_query_way(spark):
    points = clustered(4, 100, 2)
    df = frame(spark, points).select("id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))
    got = as_dict(N.nearest_to(df, "id", ["a", "b"], 70, 6))[70]
    assert got[0] == (70, 0.0)
    assert [n for n, _ in got[1:]] == [n for n, _ in brute(points, 5)[70]]


def test_probing_every_ball_is_exact(spark):
    points = clustered(5, 150, 4)
    exact = N.knn(frame(spark, points), "id", "v", 3)
    all_balls = N.knn(frame(spark, points), "id", "v", 3, strategy="balls", probe=10_000)
    assert N.neighbour_recall(exact, all_balls).first()["recall"] == 1.0
    one_ball = N.knn(frame(spark, points), "id", "v", 3, strategy="balls", probe=1)
    assert 0.3 < N.neighbour_recall(exact, one_ball).first()["recall"] <= 1.0


def test_probing_widens_until_enough_are_held(spark):
    points = clustered(7, 150, 4)
    exact = as_dict(N.knn(frame(spark, points), "id", "v", 60))
    probed = as_dict(N.knn(frame(spark, points), "id", "v", 60, strategy="balls", probe=1))
    assert {i: len(found) for i, found in probed.items()} == {i: len(found) for i, found in exact.items()}
    few = as_dict(N.knn(frame(spark, points), "id", "v", 500, strategy="balls", probe=1))
    assert {i: len(found) for i, found in few.items()} == dict.fromkeys(exact, len(points))


def test_all_components_keep_distances(spark):
    points = clustered(6, 80, 4)
    df = frame(spark, points).select("id", *[F.col("v")[i].alias(f"f{i}") for i in range(4)])
    names = [f"f{i}" for i in range(4)]
    z = zscore(df, names)
    scores, ratios = N.pca_scores(z, "id", names, 4)
    assert sum(ratios) == pytest.approx(1.0)
    a, b = as_dict(N.knn(z, "id", names, 3)), as_dict(N.knn(scores, "id", "scores", 3))
    for key in a:
        assert [d for _, d in a[key]] == pytest.approx([d for _, d in b[key]], abs=1e-8)


def test_nearest_facility_ties_and_missing_places(spark):
    points = spark.createDataFrame([("p1", 0.0, 0.0), ("p2", 5.0, 0.0), ("p3", None, 1.0)], "p string, x double, y double")
    places = spark.createDataFrame(
        [("b", 1.0, 0.0, "B"), ("a", -1.0, 0.0, "A"), ("0", None, None, "N"), ("c", 6.0, 0.0, "C")],
        "f string, lat double, long double, name string",
    )
    got = nearest_facility(points, "p", ["x", "y"], places, "f", ["lat", "long"], ["name"])
    assert {(r["p"], r["f"], r["name"], r["distance"]) for r in got.collect()} == {("p1", "a", "A", 1.0), ("p2", "c", "C", 1.0)}


def test_search_with_report_and_sentences(spark):
    rows = [(i, f"U{i}", float(i % 5), float(i // 5), float(i), 1.0 * (i % 3)) for i in range(20)]
    profile = spark.createDataFrame(rows, "code int, name string, a double, b double, c double, noise double")
    groups = {"first": ["a", "b"], "second": ["c"]}
    found = find_neighbours(profile, "code", "name", ["first"], 3, feature_groups=groups, place=["a", "b"])
    assert found.features == ["a", "b"] and not found.on_noise
    assert found.of(7).count() == 4
    report = found.report.filter("query_id = 7")
    assert report.count() == 4 and {"a", "a_norm", "b_norm", "distance"} <= set(report.columns)
    text = found.sentences.filter("query_id = 7").first()["sentence"]
    assert text.startswith("The 3 neighbours for U7 are: U") and " and U" in text
    assert found.centres.count() == 20
    assert find_neighbours(profile, "code", "name", feature_groups=groups).on_noise
    # below four features the reduced space is ignored
    assert find_neighbours(profile, "code", "name", ["first"], components=2, feature_groups=groups).variance_kept is None
    wide = find_neighbours(profile, "code", "name", ["all"], components=2, feature_groups={"all": ["a", "b", "c", "noise"]})
    assert 0 < wide.variance_kept <= 100
    same_name = profile.withColumn("name", F.lit("twin"))
    assert unit_by_name(same_name, "code", "name", "twin").first()["code"] == 0


def test_city_search_counts_the_city_itself(spark):
    rows = [(f"c{i}", float(i), 0.0, "GBR" if i < 6 else "FRA", None, 2e5 if i != 3 else 5e4) for i in range(8)]
    cities = spark.createDataFrame(rows, "city_ascii string, lat double, lng double, iso3 string, capital string, population double")
    got = city_neighbours(cities, 3)
    first = [r["neighbour_id"] for r in got.filter("query_id = 'c0'").orderBy("rank").collect()]
    assert first == ["c0", "c1", "c2"]
    assert got.select("query_id").distinct().count() == 5 and "lon" in got.columns
