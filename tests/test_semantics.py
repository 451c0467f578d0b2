"""Null, tie, zero and rounding rules on small frames."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens.functions import (
    density,
    drop_last_char,
    haversine_km,
    is_weekend,
    null_safe_sum,
    proportion,
    rate_per,
    recode,
    round_even,
    row_sum,
    season_of,
    short_key,
    weighted_mean,
)
from arealens.operators.columns import (
    columns_where,
    flatten_names,
    rename,
    sum_columns_where,
    to_long,
    unpack_array,
)
from arealens.operators.quantiles import exact_quantiles, quantile_specs
from arealens.operators.relational import calendar, first_per_key, join_on, sample_units
from arealens.operators.rollup import (
    pivot_mean,
    pivot_unique,
    rollup_units,
    sum_all_numeric,
    weighted_means,
)
from arealens.operators.scaling import (
    gaussian,
    percent_explained,
    resolve_features,
    zscore,
)
from arealens.sources import fixed


def values(df, column):
    return [r[column] for r in df.collect()]


def test_row_sum_counts_nulls_as_zero(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (None, None)], "a int, b int")
    assert values(df.select(row_sum(["a", "b"]).alias("s")), "s") == [3, 1, 0]


def test_grouped_sum_of_nulls_is_zero_and_null_keys_go(spark):
    df = spark.createDataFrame([("x", None), ("x", None), (None, 5), ("y", 2)], "k string, v int")
    got = {r["k"]: r["v"] for r in sum_all_numeric(df, ["k"]).collect()}
    assert got == {"x": 0, "y": 2}
    assert df.agg(null_safe_sum("v").alias("s")).first()["s"] == 7


def test_rounding_is_half_to_even_as_numpy(spark):
    numbers = [0.5, 1.5, 2.5, 0.125, 0.375, 2.675, 1.005, 0.0005, 0.0015, 0.0025, 0.285, 1.115, -0.5, -1.5]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for digits in (0, 1, 2, 3):
        got = values(df.select(round_even("x", digits).alias("r")), "r")
        assert got == [float(v) for v in np.round(numbers, digits)]


def test_zero_denominators_give_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a int, b int")
    row = df.select(
        proportion("a", "b").alias("p"), density("a", "b").alias("d"), rate_per("a", "b").alias("r")
    ).collect()
    assert tuple(row[0]) == (None, None, None)
    assert tuple(row[1]) == (0.25, 0.25, 25_000.0)


def test_density_scales_square_metres(spark):
    df = spark.createDataFrame([(500, 2_000_000)], "p int, a int")
    assert df.select(density("p", "a", 1, 1e6).alias("d")).first()["d"] == 250.0


def test_recode_keeps_or_drops_unmapped(spark):
    df = spark.createDataFrame([("E07000004",), ("E1",), (None,)], "c string")
    assert values(df.select(recode("c", fixed.DISTRICT_RECODES).alias("r")), "r") == ["E06000060", "E1", None]
    assert values(df.select(recode("c", {"E1": "x"}, "null").alias("r")), "r") == [None, "x", None]


def test_fixed_lists_have_their_sizes():
    assert len(fixed.DISTRICT_RECODES) == 11 and len(set(fixed.DISTRICT_RECODES.values())) == 3
    assert len(fixed.TRUST_POSTCODES) == 11
    assert len(fixed.L1_RATIOS) == 10 and fixed.N_ALPHAS == 101


def test_seasons_are_half_open_and_skip_february(spark):
    days = ["2020-11-30", "2020-12-01", "2021-01-31", "2021-02-01", "2021-03-01", "2021-05-31", "2021-06-01",
            "2021-11-30", "2021-12-01", "2022-02-01"]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(F.col("d").cast("date"))
    assert values(df.select(season_of("d", fixed.CASE_SEASONS).alias("s")), "s") == [
        "other_season", "winter_2021", "winter_2021", "other_season", "spring_2021", "spring_2021",
        "summer_2021", "autumn_2021", "winter_2022", "other_season",
    ]


def test_weekend(spark):
    df = spark.createDataFrame([("2021-11-05",), ("2021-11-06",), ("2021-11-07",), ("2021-11-08",)], "d string")
    assert values(df.select(is_weekend(F.col("d").cast("date")).alias("w")), "w") == [0, 1, 1, 0]


def test_text_helpers(spark):
    df = spark.createDataFrame([("Leeds 001A",), ("A",), ("",)], "s string")
    assert values(df.select(drop_last_char("s").alias("r")), "r") == ["Leeds 001", "", ""]
    assert values(df.select(short_key("s").alias("r")), "r")[0] == hashlib.md5(b"Leeds 001A").hexdigest()[:13]


def test_haversine_of_a_degree(spark):
    df = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"))
    assert df.first()["d"] == pytest.approx(111.195, abs=0.01)


def test_zscore_population_sd_constant_column_and_weights(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (6.0, 5.0)], "a double, b double")
    got = zscore(df, ["a", "b"], {"a": 0.5}).collect()
    a = np.array([1.0, 2, 3, 6])
    assert [r["a"] for r in got] == pytest.approx(list(0.5 * (a - a.mean()) / a.std()))
    assert [r["b"] for r in got] == [0.0] * 4


def test_noise_is_normal_and_survives_repartitioning(spark):
    df = spark.range(20_000).select("id", gaussian("id", 420).alias("n"))
    again = spark.range(20_000).repartition(3).select("id", gaussian("id", 420).alias("n"))
    assert df.join(again.withColumnRenamed("n", "m"), "id").filter("n <> m").count() == 0
    row = df.agg(F.avg("n").alias("m"), F.stddev("n").alias("s")).first()
    assert abs(row["m"]) < 0.03 and abs(row["s"] - 1) < 0.03


def test_feature_groups_fall_back_to_noise():
    assert resolve_features([], fixed.FEATURE_GROUPS) == ["noise"]
    assert len(resolve_features(list(fixed.FEATURE_GROUPS), fixed.FEATURE_GROUPS)) == 30
    with pytest.raises(ValueError):
        resolve_features(["nope"], fixed.FEATURE_GROUPS)
    assert percent_explained([0.5, 0.3, 0.2], 2) == 80.0


def quantile_frame(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.normal(size=4000)]
    rows += [("ties", float(x)) for x in rng.integers(0, 4, 500)] + [("one", 7.0), ("none", None)]
    rows += [("hot", None), (None, 1.0)]
    return spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("strategy,heavy", [("percentile", 1), ("split", 1), ("auto", 1000), ("auto", 10**9)])
def test_quantiles_agree_with_numpy_in_every_way(spark, strategy, heavy):
    df = quantile_frame(spark)
    specs = quantile_specs(["v"], {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "max": 1.0})
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], specs, strategy, heavy).collect()}
    assert set(got) == {"hot", "ties", "one", "none"}
    data = df.dropna().toPandas()
    for key, part in data.groupby("k")["v"]:
        for name, (_, q) in specs.items():
            assert got[key][name] == pytest.approx(np.quantile(part, q), abs=1e-12)
    assert got["none"]["v_q50"] is None


@pytest.mark.parametrize("sort_rows", [1, 7, 1000])
def test_ranges_narrow_to_the_bound_and_keep_the_quantiles(spark, sort_rows, monkeypatch):
    from arealens.operators import quantiles

    ends = []
    real = quantiles._inside
    monkeypatch.setattr(quantiles, "_inside", lambda c, r, g: ends.append((c, r, g)) or real(c, r, g))
    df = quantile_frame(spark).withColumn("w", -F.col("v") * F.col("v"))
    specs = quantile_specs(["v", "w"], {"q10": 0.1, "q11": 0.11, "q50": 0.5, "max": 1.0})
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], specs, "split", sort_rows=sort_rows).collect()}
    whole = {r["k"]: r for r in exact_quantiles(df, ["k"], specs, "percentile").collect()}
    assert set(got) == set(whole) == {"hot", "ties", "one", "none"}
    for key, row in whole.items():
        assert [got[key][s] for s in specs] == pytest.approx([row[s] for s in specs], abs=1e-12, nan_ok=True) if key != "none" else got[key]["v_q50"] is None
    # what a task orders in the end is one range
    counts, ranges, group = next(e for e in reversed(ends) if "_ranks" in e[1].columns)
    assert real(counts, ranges, group).groupBy(*group, "_lo").count().agg(F.max("count")).first()[0] <= sort_rows


def test_global_quantiles(spark):
    df = spark.range(1, 102).select(F.col("id").alias("v"))
    for strategy in ("percentile", "split"):
        assert exact_quantiles(df, [], {"m": ("v", 0.5)}, strategy).first()["m"] == 51.0


@pytest.mark.parametrize("strategy", ["percentile", "split", "auto"])
def test_mixed_rollup(spark, strategy):
    rows = [("a", 1, 2.0, 1.0), ("a", None, 4.0, 9.0), ("b", 3, None, 5.0), (None, 9, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "k string, s int, m double, d double")
    got = rollup_units(df, ["k"], {"s": "sum", "m": "mean", "d": "median"}, {"q": ("d", 0.25)}, strategy, 1)
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == {"a": (1, 3.0, 5.0, 3.0), "b": (3, None, 5.0, 5.0)}


def test_weighted_means_skip_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 5), ("a", 4.0, 2), ("z", 1.0, 0)], "k string, v double, w int")
    got = {r["k"]: r["v"] for r in weighted_means(df, ["k"], ["v"], "w").collect()}
    assert got == {"a": 3.0, "z": None}
    assert df.agg(weighted_mean("v", "w").alias("m")).first()["m"] == pytest.approx(9 / 8)


def test_pivot_rejects_duplicate_cells(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "r string, c string, v int")
    got = {r["r"]: (r["x"], r["y"]) for r in pivot_unique(df, ["r"], "c", ["x", "y"], "v").collect()}
    assert got == {"a": (1, 2), "b": (3, None)}
    with pytest.raises(Exception, match="duplicate cell"):
        pivot_unique(df.union(df), ["r"], "c", ["x", "y"], "v").collect()
    means = pivot_mean(df.union(df), ["r"], "c", ["x", "y"], ["v"]).orderBy("r").collect()
    assert means[0].asDict() == {"r": "a", "x_v": 1.0, "y_v": 2.0}


def test_first_per_key_is_deterministic(spark):
    df = spark.createDataFrame([("a", 2, "p"), ("a", 1, "q"), ("b", 5, None)], "k string, o int, v string")
    assert {tuple(r) for r in first_per_key(df, ["k"], ["o"]).collect()} == {("a", 1, "q"), ("b", 5, None)}


def test_joins_never_match_nulls(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 3), ("a", 4)], "j string, w int")
    assert [tuple(r) for r in join_on(left, right, {"k": "j"}).collect()] == [("a", 2, 4)]
    assert join_on(left, right, {"k": "j"}, "left").count() == 2


def test_calendars(spark):
    df = spark.createDataFrame([("2021-01-15",), ("2021-04-02",)], "d string").select(F.col("d").cast("date"))
    assert calendar(df, "d").count() == 78
    assert [str(v) for v in values(calendar(df, "d", "month"), "date")] == ["2021-02-01", "2021-03-01", "2021-04-01"]
    same = df.filter("d = '2021-01-15'")
    assert calendar(same, "d", "month").count() == 0 and calendar(same, "d").count() == 1


def test_sample_is_seeded_and_distinct(spark):
    df = spark.range(100).union(spark.range(100)).withColumnRenamed("id", "u")
    a, b, c = (values(sample_units(x, "u", 12, s), "u") for x, s in ((df, 4), (df.repartition(5), 4), (df, 5)))
    assert a == b and len(set(a)) == 12 and a != c


def test_column_tools(spark):
    df = spark.createDataFrame([(1, 2, None, 4)], "`Group: A: Total` int, `Group: A: Part` int, `Group: A2: Total` int, id int")
    assert columns_where(df, "Group: A", ": Total") == ["Group: A: Total", "Group: A2: Total"]
    assert sum_columns_where(df, {"a": ("Group: A", ": Total"), "none": ("zzz",)}).select("a", "none").first() == (1, 0)
    assert rename(df, str.lower).columns[0] == "group: a: total"
    assert flatten_names([("a", 1), ("b", "")]) == ["a_1", "b"]
    packed = spark.createDataFrame([("k", [1.0, 2.0])], "k string, l array<double>")
    wide = unpack_array(packed, "l", ["p", "q", "r"])
    assert tuple(wide.first()) == ("k", 1.0, 2.0, None)
    assert to_long(wide, ["k"], ["p", "q"], "n", "v").count() == 2
