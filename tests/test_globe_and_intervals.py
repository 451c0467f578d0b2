"""Great-circle search, interval joins, all levels at once, scenario tables and leaf tables."""

import math
import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from arealens.operators.globe import cell_tree, nearest_on_globe
from arealens.operators.intervals import interval_join, label_by_interval, overlapping
from arealens.operators.scenario import fit_forest, forest_leaves, predict, predict_by_leaves, scenario_effect, scenario_table_effects
from arealens.plans.profile import level_profiles, unit_profile
from arealens.workload.registry import Tables
from arealens.workload.views import SPEC, small_areas


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def km(a, b):
    (p, l), (q, m) = [tuple(map(math.radians, x)) for x in (a, b)]
    return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((m - l) / 2) ** 2))


@pytest.mark.parametrize("crowded", [False, True])
def test_nearest_on_globe_equals_brute_force(spark, crowded):
    draw = random.Random(crowded)
    spot = lambda: (draw.uniform(-90, 90), draw.uniform(-180, 180))
    town = lambda: (51.5 + draw.uniform(-1e-4, 1e-4), -0.1 + draw.uniform(-1e-4, 1e-4))
    places = {i: town() if crowded and i % 3 else spot() for i in range(400)}
    places |= {400: (90.0, 10.0), 401: (-90.0, 0.0), 402: (0.0, 180.0), 403: (10.0, -179.99)}
    asked = {i: spot() for i in range(200)} | {200: (89.9, -170.0), 201: (0.0, -180.0), 202: (10.0, 539.99), 203: town(), 204: (51.5, -0.1)}
    points = spark.createDataFrame([(i, *p) for i, p in asked.items()], "pid long, lat double, long double")
    sites = spark.createDataFrame([(i, *p, f"n{i}") for i, p in places.items()], "fid long, la double, lo double, name string")
    found = nearest_on_globe(points, "pid", ["lat", "long"], sites, "fid", ["la", "lo"], carry=["name"], most=4).collect()
    assert len(found) == len(asked)
    for r in found:
        best = min((km(asked[r.pid], p), i) for i, p in places.items())
        assert r.distance_km == pytest.approx(best[0], abs=1e-6) and r.name == f"n{r.fid}"
        assert km(asked[r.pid], places[r.fid]) == pytest.approx(best[0], abs=1e-6)


def test_nearest_on_globe_of_odd_rows(spark):
    sites = spark.createDataFrame([(2, 1.0, 1.0), (1, 1.0, 1.0), (3, None, 1.0), (None, 5.0, 5.0), (4, 95.0, 1.0)], "fid long, la double, lo double")
    points = spark.createDataFrame([(1, 1.0, 361.0), (2, None, 0.0), (None, 1.0, 1.0), (3, 5.0, 5.0)], "pid long, lat double, long double")
    found = nearest_on_globe(points, "pid", ["lat", "long"], sites, "fid", ["la", "lo"]).collect()
    assert sorted((r.pid, r.fid) for r in found) == [(1, 1), (3, 1)]
    assert nearest_on_globe(points, "pid", ["lat", "long"], sites.limit(0), "fid", ["la", "lo"]).count() == 0


def test_points_on_the_globe_do_not_pass_through_the_driver(spark):
    sites = spark.createDataFrame([(i, i * 0.7 - 40.0, i * 3.0 - 170.0, f"n{i}") for i in range(100)], "fid long, la double, lo double, name string")
    points = spark.createDataFrame([(1, 0.0, 10.0), (2, -0.0, 10.0), (3, 5.0, 5.0)], "pid long, lat double, long double")
    found = nearest_on_globe(points, "pid", ["lat", "long"], sites, "fid", ["la", "lo"], carry=["name"], most=4)
    assert "Broadcast" not in plan(found)
    # one place whichever way its zero is signed
    assert sorted(r.pid for r in found.collect()) == [1, 2, 3]


def test_crowded_cells_are_divided(spark):
    draw = random.Random(2)
    rows = [tuple(v / 1e3 for v in (draw.gauss(0, 1), draw.gauss(0, 1), draw.gauss(0, 1))) for _ in range(2000)]
    cells, leaves = cell_tree(spark.createDataFrame(rows, "x double, y double, z double"), 16)
    assert leaves.groupBy("cell").count().agg(F.max("count")).first()[0] <= 16
    assert leaves.count() == 2000 and cells.where("parent is null").count() == 1


def test_interval_join_equals_brute_force_and_is_an_equi_join(spark):
    draw = random.Random(3)
    spans = [(i, s, s + draw.choice([0, 1, 2, 3, 7, 100, 5000]) - draw.choice([0, 0, 2])) for i in range(200) for s in [draw.randint(-500, 500)]]
    values = [(i, draw.randint(-600, 6000)) for i in range(500)] + [(500, None)]
    intervals = spark.createDataFrame([*spans, (200, None, 5), (201, 5, None)], "name long, start long, end long")
    found = interval_join(spark.createDataFrame(values, "id long, at long"), "at", intervals)
    wanted = sorted((i, n) for i, v in values for n, s, e in spans if v is not None and s <= v < e)
    assert sorted((r.id, r.name) for r in found.collect()) == wanted
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_interval_join_of_doubles_and_timestamps(spark):
    halves = spark.createDataFrame([("a", 0.5, 1.25), ("b", -0.75, 0.5)], "name string, start double, end double")
    points = spark.createDataFrame([(v,) for v in (-0.75, 0.49, 0.5, 1.2, 1.25)], "at double")
    assert sorted((r.at, r.name) for r in interval_join(points, "at", halves).collect()) == [(-0.75, "b"), (0.49, "b"), (0.5, "a"), (1.2, "a")]
    for kind in ("timestamp", "timestamp_ntz"):
        cast = lambda df, *cs: df.select(*[F.col(c).cast(kind) if c != "name" else F.col(c) for c in df.columns])
        spans = cast(spark.createDataFrame([("a", "2020-03-01 10:00:00.5", "2020-03-01 10:00:01")], "name string, start string, end string"))
        times = cast(spark.createDataFrame([("2020-03-01 10:00:00.4",), ("2020-03-01 10:00:00.6",), ("2020-03-01 10:00:01",)], "at string"))
        assert interval_join(times, "at", spans).count() == 1


def test_labels_overlaps_and_empty_tables(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("b", 10, 11), ("c", 20, 2000)], "name string, start long, end long")
    points = spark.createDataFrame([(v,) for v in (0, 10, 11, 1999, None, 0)], "at long")
    found = label_by_interval(points, "at", spans, "name", "label", other="none")
    assert sorted((r.at if r.at is not None else -1, r.label) for r in found.collect()) == [(-1, "none"), (0, "a"), (0, "a"), (10, "b"), (11, "none"), (1999, "c")]
    assert "NestedLoop" not in plan(found)
    clash = spans.unionByName(spark.createDataFrame([("d", 1999, 2001)], spans.schema))
    assert [(r.first, r.second) for r in overlapping(clash, "name").collect()] == [("c", "d")]
    with pytest.raises(ValueError, match="overlap"):
        label_by_interval(points, "at", clash, "name", "label")
    assert [r.label for r in label_by_interval(points.limit(2), "at", spans.limit(0), "name", "label").collect()] == [None, None]


def test_overlaps_of_names_with_several_intervals_equal_brute_force(spark):
    draw = random.Random(9)
    spans = [(draw.randint(0, 25) if i % 3 else 100 + i, s, s + draw.choice([0, 1, 2, 5, 30])) for i in range(150) for s in [draw.randint(0, 200)]]
    spans += spans[:40]
    rows = spark.createDataFrame([*spans, (None, 0, 50), (7, None, 5)], "name int, start int, end int")
    wanted = {(a, b) for a, s, e in spans for b, t, u in spans if a != b and t < u and s <= t < e}
    found = [tuple(r) for r in overlapping(rows, "name").collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_overlaps_of_single_intervals_are_not_aggregated(spark):
    spans = spark.createDataFrame([(i, i % 10, i % 10 + 1 + i % 4) for i in range(60)], "name int, start int, end int")
    found = overlapping(spans.unionByName(spans), "name")
    above_the_join = plan(found).split("SortMergeJoin")[0]
    assert "Join" not in above_the_join and "Aggregate" not in above_the_join and "Exchange" not in above_the_join
    assert found.count() == found.distinct().count() == sum(i != j and i % 10 <= j % 10 < i % 10 + 1 + i % 4 for i in range(60) for j in range(60))


def test_all_levels_equal_single_levels_and_read_once(spark):
    areas = small_areas(Tables(spark, DATA))
    together = level_profiles(areas, spec=SPEC, noise_seed=None, strategy="percentile")
    assert plan(together).count("orders.parquet") == 1
    rows = {(r.level, r.code): r.asDict() for r in together.collect()}
    for level, (code, name) in SPEC.levels.items():
        single = unit_profile(areas, level, SPEC, noise_seed=None, strategy="percentile").collect()
        assert {str(r[code]) for r in single} == {c for l, c in rows if l == level}
        for r in single:
            one = r.asDict()
            many = rows[level, str(one.pop(code))]
            assert many["name"] == one.pop(name)
            assert all(many[c] == pytest.approx(v) for c, v in one.items())
    split = {(r.level, r.code): r.asDict() for r in level_profiles(areas, spec=SPEC, noise_seed=None, strategy="split").collect()}
    assert all(split[k][c] == pytest.approx(v) for k, r in rows.items() for c, v in r.items() if isinstance(v, float))


@pytest.fixture(scope="module")
def forest(spark):
    draw = random.Random(4)
    rows = [(i % 7, draw.random(), draw.random(), draw.random()) for i in range(600)]
    panel = spark.createDataFrame([(a, x, y, 3 * x - y * y + z / 10) for a, x, y, z in rows], "area long, x double, y double, r double")
    return panel, fit_forest(panel, ["x", "y"], "r", trees=5)


def test_scenario_table_equals_one_by_one(spark, forest):
    panel, model = forest
    table = [("up", "x", 0.2), ("up", "x", 0.1), ("down", "y", -0.5), ("down", "x", 0.1), ("none", None, None), ("null", "x", None)]
    scenarios = spark.createDataFrame(table, "scenario string, feature string, shift double")
    wanted = {"up": {"x": 0.2 + 0.1}, "down": {"y": -0.5, "x": 0.1}, "none": {}, "null": {}}
    for at_once in (256, 3):
        found = scenario_table_effects(model, panel, ["x", "y"], "r", scenarios, ["area"], at_once)
        rows = {(r.scenario, r.area): r for r in found.collect()}
        assert len(rows) == 28
        for name, shifts in wanted.items():
            for r in scenario_effect(model, panel, ["x", "y"], "r", shifts, ["area"]).collect():
                assert rows[name, r.area].effect == pytest.approx(r.effect, abs=1e-12) and rows[name, r.area].expected == pytest.approx(r.expected)
    assert all(r.effect == 0 for (name, _), r in rows.items() if name in ("none", "null"))
    with pytest.raises(ValueError, match="no input"):
        scenario_table_effects(model, panel, ["x", "y"], "r", scenarios.withColumn("feature", F.lit("z")), ["area"])


def test_leaves_predict_like_the_model(forest):
    panel, model = forest
    leaves = forest_leaves(model, panel)
    assert leaves.select("tree").distinct().count() == 5
    both = predict_by_leaves(predict(model, panel, ["x", "y"], "wanted"), leaves, ["x", "y"], "found")
    assert both.where("abs(found - wanted) > 1e-9 or found is null").count() == 0
    assert "Python" not in plan(both)


def test_seasons_as_a_table_equal_the_list(spark):
    from arealens.plans.areas import seasonal_cases

    days = [("E1", f"2021-{m:02d}-{d:02d}", 10 * m + d) for m in range(1, 13) for d in (1, 15, 28)]
    cases = spark.createDataFrame(days, "areaCode string, date string, newCasesBySpecimenDate long")
    bridge = spark.createDataFrame([("a", "E1", 3), ("b", "E1", 5)], "`LSOA Code` string, LAD21CD string, pop_all_ages long")
    listed = [("spring", "2021-03-01", "2021-06-01"), ("late", "2021-10-01", "2021-12-15")]
    table = spark.createDataFrame(listed, "name string, start string, end string")
    table = table.select("name", F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
    one, two = (seasonal_cases(cases, bridge, seasons=s).collect() for s in (listed, table))
    assert sorted(one) == sorted(two) and len(one) == 4


def test_trusts_by_great_circle(spark):
    from arealens.plans.areas import trust_map

    areas = spark.createDataFrame([("E1", 60.0, 0.0)], "lsoa11cd string, lati double, long double")
    trusts = spark.createDataFrame([("T1", "one", 60.0, 1.6), ("T2", "two", 61.0, 0.0)], "areaCode string, areaName string, latitude double, longitude double")
    assert trust_map(areas, trusts).first().nhstrustcd == "T2"
    assert trust_map(areas, trusts, great_circle=True).first().nhstrustcd == "T1"  # degrees of longitude are short up there
