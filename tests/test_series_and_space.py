"""Rolling means, allocation, polygons and densities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens.operators.allocation import allocate_to_children, share_of_total
from arealens.operators.density import kde
from arealens.operators.series import daily_totals, monthly_features, rolling_mean, rolling_rate
from arealens.operators.spatial import polygon_measures


def daily(spark, lengths, gap=1):
    rows = [(u, f"2021-01-{1 + i * gap:02d}", float(i)) for u, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "u string, d string, y double").withColumn("d", F.col("d").cast("date"))


@pytest.mark.parametrize("gap", [1, 3])
def test_rolling_needs_seven_rows_and_ignores_gaps(spark, gap):
    df = rolling_mean(daily(spark, {"six": 6, "seven": 7, "eight": 8}, gap), "u", "d", "y", "m")
    got = {u: [r["m"] for r in df.filter(F.col("u") == u).orderBy("d").collect()] for u in ("six", "seven", "eight")}
    assert got == {"six": [None] * 6, "seven": [None] * 6 + [3.0], "eight": [None] * 6 + [3.0, 4.0]}


def test_a_missing_value_empties_the_frame(spark):
    df = daily(spark, {"a": 9}).withColumn("y", F.when(F.dayofmonth("d") != 2, F.col("y")))
    got = [r["m"] for r in rolling_mean(df, "u", "d", "y", "m").orderBy("d").collect()]
    assert got[:8] == [None] * 8 and got[8] == 5.0


def test_rate_is_cut_after_rolling(spark):
    pop = spark.createDataFrame([("a", 50_000)], "code string, pop int")
    df = rolling_rate(daily(spark, {"a": 10}), pop, {"u": "code"}, "d", "y", "pop", start="2021-01-08")
    rows = df.orderBy("d").collect()
    assert len(rows) == 3 and rows[0]["rolling_rate"] == 2 * 4.0


def test_daily_totals_combine_rows(spark):
    df = daily(spark, {"a": 2}).union(daily(spark, {"a": 2}))
    assert [r["value"] for r in daily_totals(df, "u", "d").orderBy("date").collect()] == [2, 2]
    assert [r["value"] for r in daily_totals(df, "u", "d", "y").orderBy("date").collect()] == [0.0, 2.0]


def test_months_of_different_years(spark):
    rows = [("a", "2020-05-01", 1.0), ("a", "2021-05-01", 3.0), ("a", "2021-06-01", None)]
    df = spark.createDataFrame(rows, "u string, d string, y double").withColumn("d", F.col("d").cast("date"))
    assert monthly_features(df, "u", "d", "y", {"q50": 0.5}).count() == 3
    merged = {r["month"]: r["y_q50"] for r in monthly_features(df, "u", "d", "y", {"q50": 0.5}, month_of_year=True).collect()}
    assert merged == {5: 2.0, 6: None}
    with_mean = monthly_features(df, "u", "d", "y", month_of_year=True, with_mean=True).filter("month = 5").first()
    assert with_mean["y_mean"] == 2.0


def test_allocation_sums_to_parents(spark):
    totals = spark.createDataFrame([("A", "s1", 100), ("A", "s2", 7), ("B", "s1", 5), ("none", "s1", 9)], "p string, season string, v int")
    bridge = spark.createDataFrame(
        [("A", "a1", 3), ("A", "a2", 0), ("A", "a3", 4), ("B", "b1", 0), ("lost", "x", 1)], "p string, c string, w int"
    )
    got = allocate_to_children(totals, bridge, "p", "v", "w", "share").collect()
    by = {(r["c"], r["season"]): r["share"] for r in got}
    assert by[("a2", "s1")] == 0.0 and by[("b1", "s1")] is None and ("x", "s1") not in by and len(by) == 7
    for season, total in (("s1", 100), ("s2", 7)):
        assert sum(v for (c, s), v in by.items() if c[0] == "a" and s == season) == pytest.approx(total, abs=0.015)


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("z", 0.0)], "k string, v double")
    got = sorted((r["k"], r["v"], r["s"]) for r in share_of_total(df, ["k"], "v", "s").collect())
    assert got == [("a", 1.0, 0.25), ("a", 3.0, 0.75), ("z", 0.0, None)]


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]
HOLE = [(1, 1), (1, 2), (2, 2), (2, 1)]


def rings(spark, units, step=1):
    rows = [
        (unit, ring, seq * step, float(x), float(y))
        for unit, shapes in units.items()
        for ring, shape in enumerate(shapes)
        for seq, (x, y) in enumerate(shape)
    ]
    return spark.createDataFrame(rows, "u string, ring int, seq int, x double, y double")


@pytest.mark.parametrize("chunk,step", [(4096, 1), (1, 1), (2, 1), (3, 5)])
def test_polygons_with_holes_parts_and_any_chunking(spark, chunk, step):
    far = [(x + 10, y) for x, y in SQUARE]
    df = rings(spark, {"square": [SQUARE], "holed": [SQUARE, HOLE], "parts": [SQUARE, far]}, step)
    got = {r["u"]: r for r in polygon_measures(df, "u", chunk=chunk).collect()}
    assert (got["square"]["area"], got["square"]["centroid_x"], got["square"]["centroid_y"]) == (16.0, 2.0, 2.0)
    assert got["holed"]["area"] == 15.0
    assert got["holed"]["centroid_x"] == pytest.approx((16 * 2 - 1.5) / 15)
    assert (got["parts"]["area"], got["parts"]["centroid_x"]) == (32.0, 7.0)


def test_closed_rings_and_square_kilometres(spark):
    df = rings(spark, {"u": [[(x * 1000, y * 1000) for x, y in [*SQUARE, SQUARE[0]]]]})
    assert polygon_measures(df, "u", unit_scale=1e6).first()["area"] == 16.0


def test_density_matches_direct_sum_and_integrates_to_one(spark):
    x = np.random.default_rng(2).normal(size=300)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    got = sorted((r["i"], r["x"], r["density"]) for r in kde(df, "v").collect())
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 200)
    direct = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert [g for _, g, _ in got] == pytest.approx(grid.tolist())
    assert [d for _, _, d in got] == pytest.approx(direct.tolist())
    assert np.trapezoid(direct, grid) == pytest.approx(1.0, abs=0.01)


def test_density_of_ties_gaps_and_values_that_are_not_finite(spark):
    x = np.concatenate([np.zeros(5000), np.random.default_rng(3).normal(100, 0.5, 5000), [40.25]])
    rows = [(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),), (float("-inf"),)]
    got = sorted(tuple(r) for r in kde(spark.createDataFrame(rows, "v double"), "v", grid=2000).collect())
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 2000)
    direct = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert [i for i, _, _ in got] == list(range(2000))
    assert [d for _, _, d in got] == pytest.approx(direct.tolist(), rel=1e-9, abs=1e-15)


def test_density_of_a_constant_is_empty(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert kde(df, "v").count() == 0


def test_complete_days_fill_every_unit_over_the_whole_span(spark):
    from arealens.operators.series import complete_days

    daily = spark.sql("select * from values ('a', date'2020-01-01', 3L), ('a', date'2020-01-03', 1L), ('b', date'2020-01-04', 2L) as t(u, date, n)")
    got = sorted((r.u, r.date.day, r.n) for r in complete_days(daily, "u", "n").collect())
    assert got == [("a", 1, 3), ("a", 2, 0), ("a", 3, 1), ("a", 4, 0), ("b", 1, 0), ("b", 2, 0), ("b", 3, 0), ("b", 4, 2)]
