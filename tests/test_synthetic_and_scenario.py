"""Donor weights, trajectories, forests and effects."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealens.operators import synthetic as S
from arealens.operators.scenario import (
    apply_scenarios,
    daily_panel,
    feature_importances,
    fit_forest,
    mean_effect,
    predict,
    regression_metrics,
    scenario_effect,
    shift_columns,
)
from arealens.plans.control import district_rates, pre_period_features, synthetic_control
from arealens.plans.whatif import scenario_features, what_if
from arealens.sources import fixed


def objective(x, y, w, l1, l2):
    return ((y - x @ w) ** 2).sum() / (2 * len(y)) + l1 * w.sum() + l2 / 2 * (w**2).sum()


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("ratio", [0.05, 0.7, 1.0])
def test_weights_satisfy_the_optimality_conditions(seed, ratio):
    rng = np.random.default_rng(seed)
    n, p = 12, 40 if seed % 2 else 6
    base = rng.gamma(2, 20, size=(n, 1))
    x = np.abs(base + rng.normal(0, 8, size=(n, p)))
    x[:, -1] = x[:, 0]  # a donor collinear with another
    y = np.abs(base[:, 0] + rng.normal(0, 5, n))
    w = None
    for alpha in S.alpha_path(x, y, ratio, 9):
        l1, l2 = alpha * ratio, alpha * (1 - ratio)
        w, done = S.nonnegative_weights(x, y, l1, l2, w)
        slope = x.T @ (y - x @ w) / n - l1 - l2 * w
        scale = np.abs(x.T @ y).max() / n
        assert done and (w >= 0).all()
        assert np.where(w > 0, np.abs(slope), np.maximum(slope, 0)).max() < 1e-7 * scale
        nudged = np.maximum(w + rng.normal(0, 1e-3, p), 0)
        assert objective(x, y, w, l1, l2) <= objective(x, y, nudged, l1, l2) + 1e-9


def test_penalty_path_and_folds():
    x, y = np.array([[1.0, 2.0], [0.0, 4.0], [1.0, 1.0]]), np.array([1.0, 2.0, 3.0])
    path = S.alpha_path(x, y, 0.5, 101)
    assert path[0] == pytest.approx(13 / 1.5) and path[-1] == pytest.approx(path[0] * 1e-3) and len(path) == 101
    w, _ = S.nonnegative_weights(x, y, path[0] * 0.5, path[0] * 0.5)
    assert not w.any()
    assert S.cross_validated_weights(x, y, (0.5,), 5, 10)["weights"].shape == (2,)


def planted(spark, n=15, p=20):
    rng = np.random.default_rng(7)
    base = rng.gamma(2, 20, size=(n, 1))
    x = np.abs(base + rng.normal(0, 10, size=(n, p)))
    x[:, 0] = 0.6 * x[:, 3] + 0.4 * x[:, 7]
    rows = [(f"u{j:02d}", x[:, j].tolist()) for j in range(p)]
    return spark.createDataFrame(rows, "unit string, vec array<double>")


def test_planted_donors_are_recovered(spark):
    vectors = planted(spark)
    targets = spark.createDataFrame([("u00",)], "unit string")
    rows = S.fit_weights(vectors, targets, l1_ratios=(0.5, 1.0), n_alphas=31).orderBy(F.desc("weight")).collect()
    assert [r["donor"] for r in rows[:2]] == ["u03", "u07"]
    assert [r["weight"] for r in rows[:2]] == pytest.approx([0.6, 0.4], abs=0.03)
    assert all(not r["capped"] and r["kkt"] < 1e-7 for r in rows)
    barred = spark.createDataFrame([("u00", "u03")], "target string, excluded string")
    donors = {r["donor"] for r in S.fit_weights(vectors, targets, barred, (0.5,), 9).collect()}
    assert "u03" not in donors and "u00" not in donors


def test_distributed_pool_gives_the_same_weights(spark, monkeypatch):
    monkeypatch.setattr(S, "ADDED_DONORS", 2)
    monkeypatch.setattr(S, "SURVIVORS", 3)
    monkeypatch.setattr(S, "POOL_PIECE", 6)
    monkeypatch.setattr(S, "FIT_CELLS", 1)
    vectors = planted(spark, 5, 20).repartition(3)
    targets = spark.createDataFrame([("u00",), ("u05",)], "unit string")
    barred = spark.createDataFrame([("u05", "u06")], "target string, excluded string")
    for grid in ((0.6,), (1.0,)):
        shared, spread = (
            {(r["target"], r["donor"]): r for r in S.fit_weights(vectors, targets, barred, grid, 3, 2, way).collect()}
            for way in ("shared", "distributed")
        )
        assert shared.keys() == spread.keys()
        for key, row in shared.items():
            assert spread[key]["weight"] == pytest.approx(row["weight"], abs=1e-7)
            assert spread[key]["alpha"] == pytest.approx(row["alpha"])
            assert spread[key]["cv_mse"] == pytest.approx(row["cv_mse"], rel=1e-6)
            assert spread[key]["kkt"] < 1e-7 and not spread[key]["capped"]


def test_a_distributed_pool_takes_in_donors_it_left_out(spark, monkeypatch):
    taken = []
    entering = S._first_by_score
    monkeypatch.setattr(S, "SURVIVORS", 2)
    monkeypatch.setattr(S, "_first_by_score", lambda pairs, most: taken.append(most) or entering(pairs, most))
    vectors = planted(spark, 4, 40)
    targets = spark.createDataFrame([("u00",), ("u09",), ("nobody",)], "unit string")
    shared, spread = (
        sorted((r.target, r.donor, round(r.weight, 7)) for r in S.fit_weights(vectors, targets, None, (0.3,), 9, 2, way).collect())
        for way in ("shared", "distributed")
    )
    assert shared == spread and len(taken) > 2


def test_a_pool_over_the_limit_is_not_shared(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_DONOR_CELLS", 30)
    targets = spark.createDataFrame([("u00",)], "unit string")
    with pytest.raises(ValueError):
        S.fit_weights(planted(spark), targets, l1_ratios=(1.0,), n_alphas=2, folds=2, strategy="shared")
    rows = S.fit_weights(planted(spark), targets, l1_ratios=(1.0,), n_alphas=3, folds=2).collect()
    assert rows and all(r["weight"] > 0 for r in rows)


def test_units_missing_a_feature_are_left_out(spark):
    rows = [("a", "q1", 1, 5.0), ("a", "q1", 2, 6.0), ("b", "q1", 1, 7.0), ("b", "q1", 2, None)]
    df = spark.createDataFrame(rows, "u string, f string, m int, v double")
    assert [tuple(r) for r in S.unit_vectors(df, "u", ["f", "m"], "v").collect()] == [("a", [5.0, 6.0])]


def test_donor_pool_leaves_out_the_neighbourhood(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "unit int, lat double, long double")
    assert {r["unit"] for r in S.donor_pool(df, "unit", "lat", "long", 0, 3).collect()} == set(range(4, 10))
    assert S.donor_pool(df, "unit", "lat", "long", 0, 50).count() == 0
    pairs = S.exclusions(df, "unit", "lat", "long", 2)
    assert {r["excluded"] for r in pairs.filter("target = 9").collect()} == {9, 8, 7}


def test_trajectory_needs_every_weighted_donor(spark):
    weights = spark.createDataFrame([("t", "a", 0.5), ("t", "b", 0.25), ("t", "z", 0.0)], "target string, donor string, weight double")
    rows = [("t", 1, 9.0), ("a", 1, 4.0), ("b", 1, 8.0), ("z", 1, 1.0), ("t", 2, 7.0), ("a", 2, 2.0), ("z", 2, 1.0), ("t", 3, 1.0)]
    series = spark.createDataFrame(rows, "u string, d int, y double")
    got = {r["date"]: (r["observed"], r["synthetic"]) for r in S.synthetic_trajectory(weights, series, "u", "d", "y").collect()}
    assert got == {1: (9.0, 4.0), 2: (7.0, None), 3: (1.0, None)}
    shares = S.normalised_weights(weights).collect()
    assert [(r["donor"], r["normalised_weight"]) for r in shares] == [("a", pytest.approx(2 / 3)), ("b", pytest.approx(1 / 3))]


def test_control_end_to_end(spark):
    rng = np.random.default_rng(1)
    days = [datetime.date(2020, 8, 20) + datetime.timedelta(i) for i in range(170)]
    level = 50 + 30 * np.sin(np.arange(170) / 15)
    curves = {f"E{j}": level * rng.uniform(0.5, 1.5) + 20 * np.sin(np.arange(170) / (7 + j)) + 25 for j in range(8)}
    curves["E0"] = 0.7 * curves["E5"] + 0.3 * curves["E6"]
    rows = [("ltla", u, d, int(round(v * 100))) for u, c in curves.items() for d, v in zip(days, c)]
    rows += [("nation", "E0", days[0], 10**6)]
    cases = spark.createDataFrame(rows, "`Area type` string, `Area code` string, `Specimen date` date, `Daily lab-confirmed cases` long")
    population = spark.createDataFrame([(u, 100_000.0) for u in curves], "Code string, pop_total double")
    rates = district_rates(cases, population)
    assert rates.agg(F.min("date")).first()[0] == datetime.date(2020, 9, 1)
    assert rates.filter("rolling_rate is null").count() == 0
    places = spark.createDataFrame([(u, float(i), 0.0) for i, u in enumerate(curves)], "unit string, lat double, long double")
    targets = spark.createDataFrame([("E0",)], "unit string")
    result = synthetic_control(rates, places, targets, exclude=2, end="2021-01-01", l1_ratios=(0.9, 1.0), n_alphas=15, folds=4, background=3)
    donors = {r["donor"]: r["normalised_weight"] for r in result.donors.collect()}
    assert donors and not {"E0", "E1", "E2"} & set(donors) and sum(donors.values()) == pytest.approx(1.0)
    assert sorted(donors, key=donors.get)[-1] == "E5"
    miss = result.trajectory.agg(F.avg(F.abs(F.col("observed") - F.col("synthetic")) / F.col("observed")).alias("m")).first()["m"]
    assert miss < 0.05
    assert result.background.select("unit").distinct().count() == 3
    merged = pre_period_features(rates.select("unit", "date", "rolling_rate"), months_of_year=[9, 1])
    assert {r["month"] for r in merged.select("month").distinct().collect()} == {9, 1}


# ---------------------------------------------------------------- scenarios
def panel(spark, n=400):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        a, b, noise = (float(v) for v in rng.normal(size=3))
        day = datetime.date(2021, 11, 1) + datetime.timedelta(i % 20)
        rows.append((day, f"area{i // 20 % 5}", a, b, 3 * a + 0.1 * noise))
    return spark.createDataFrame(rows, "date date, area string, a double, b double, y double")


def test_forest_finds_the_driver_and_zero_shift_has_no_effect(spark):
    df = panel(spark)
    model = fit_forest(df, ["a", "b"], "y")
    order = feature_importances(model, ["a", "b"], df).collect()
    assert order[0]["feature"] == "a" and sum(r["importance"] for r in order) == pytest.approx(1.0)
    fitted = predict(model, df, ["a", "b"], "expected")
    metrics = regression_metrics(fitted, "y", "expected").first()
    assert metrics["rmse"] == pytest.approx(metrics["mse"] ** 0.5) and metrics["rmse"] < 1 and metrics["mae"] <= metrics["rmse"]
    zero = scenario_effect(model, df, ["a", "b"], "y", {}, ["date", "area"])
    assert zero.filter("effect <> 0").count() == 0
    up = scenario_effect(model, df, ["a", "b"], "y", {"a": 1.0}, ["date", "area"])
    assert up.agg(F.avg("effect")).first()[0] > 0.5
    assert mean_effect(up, "area").count() == 5
    assert set(fitted.columns) == {*df.columns, "expected"}


def test_rows_with_missing_inputs_are_left_out(spark):
    df = panel(spark).withColumn("b", F.when(F.col("area") != "area1", F.col("b")))
    model = fit_forest(df, ["a", "b"], "y", trees=2, depth=2)
    effects = scenario_effect(model, df, ["a", "b"], "y", {"a": 1.0}, ["area"])
    assert {r["area"] for r in effects.collect()} == {"area0", "area2", "area3", "area4"}


def test_shifts_and_named_scenarios(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert tuple(shift_columns(df, {"a": -3}).first()) == (-2.0, 2.0)
    got = {r["scenario"]: (r["a"], r["b"]) for r in apply_scenarios(df, {"none": {}, "both": {"a": 1, "b": -1}}).collect()}
    assert got == {"none": (1.0, 2.0), "both": (2.0, 1.0)}


def test_panel_joins_by_day_and_area(spark):
    moving = spark.createDataFrame([("2021-11-06", "x", 1.0), ("2021-11-08", "x", 2.0)], "date string, la string, m double")
    rt = spark.createDataFrame([("2021-11-06", "x", 0.9), ("2021-11-06", "z", 0.9)], "date string, la string, rt double")
    row = daily_panel(moving, rt, ["date", "la"], "date").collect()
    assert len(row) == 1 and (row[0]["ymonth"], row[0]["is_weekend"]) == (11, 1)


def test_what_if_end_to_end(spark):
    rng = np.random.default_rng(5)
    days = [datetime.date(2021, 10, 20) + datetime.timedelta(i) for i in range(40)]
    rows, rts = [], []
    for code, name in (("E1", "Bolton"), ("E2", "Derby"), ("E3", "Watford")):
        for d in days:
            m = [float(v) for v in rng.normal(0, 10, 6)]
            rows.append((d, *m, code, name))
            rts.append((name, d, 1 + 0.02 * m[0]))
    rows.append((days[0], None, 0.0, 0.0, 0.0, 0.0, 0.0, "E1", "Bolton"))
    columns = ", ".join(f"{c} double" for c in fixed.MOBILITY_COLUMNS.values())
    mobility = spark.createDataFrame(rows, f"date date, {columns}, lad19cd string, la_name string")
    rt = spark.createDataFrame(rts, "la_name string, date date, Rt double")
    profile = spark.createDataFrame([(f"E{i}", float(i), 2.0, 3.0, 4.0) for i in (1, 2, 3)], "LAD21CD string, imd_full double, imd_health double, imd_employ double, imd_living double")
    result = what_if(mobility, rt, profile, {"retail_mob": 15.0}, ["IMD"])
    assert result.features == scenario_features(["IMD"]) and len(result.features) == 9
    assert result.panel.count() == 120 and result.effects.count() == 120
    assert result.importances.first()["feature"] == "retail_mob"
    assert result.effects.agg(F.avg("effect")).first()[0] > 0.1
    assert result.metrics.first()["rmse"] < 0.2
    assert result.effect_density("2021-11-01", ["Bolton", "Derby", "Watford"]).count() == 200


def test_vectors_hold_the_same_features_in_the_same_places(spark):
    rows = [("a", "f", 1, 1.0), ("a", "f", 2, 2.0), ("b", "f", 2, 3.0), ("b", "f", 3, 4.0), ("c", "f", 1, 5.0), ("c", "f", 2, 6.0), ("c", "f", 3, 7.0)]
    df = spark.createDataFrame(rows, "u string, f string, m int, v double")
    vectors = S.unit_vectors(df, "u", ["f", "m"], "v")
    assert [tuple(r) for r in vectors.collect()] == [("c", [5.0, 6.0, 7.0])]
    weights = spark.createDataFrame([], S.WEIGHT_SCHEMA.format(id="string"))
    targets = spark.createDataFrame([("a",), ("c",)], "unit string")
    status = {r.target: r.status for r in S.target_status(targets, vectors, weights).collect()}
    assert status == {"a": "features missing", "c": "no weight"}


def test_exclusions_of_listed_targets_equal_those_of_all(spark):
    places = spark.range(60).selectExpr("id as unit", "cast(id % 7 as double) as lat", "cast(id % 11 as double) as long")
    wanted = {(r.target, r.excluded) for r in S.exclusions(places, "unit", "lat", "long", 4).collect() if r.target in (3, 8)}
    targets = spark.createDataFrame([(3,), (8,)], "unit long")
    assert {(r.target, r.excluded) for r in S.exclusions(places, "unit", "lat", "long", 4, targets).collect()} == wanted


def test_a_target_without_any_weight_leaves_the_others_whole(spark):
    from arealens.operators.synthetic import fit_weights

    rng = np.random.default_rng(8)
    donors = rng.uniform(1, 2, (4, 12))
    rows = [(f"d{i}", [float(x) for x in v]) for i, v in enumerate(donors)]
    rows += [("near", [float(x) for x in donors[0]]), ("none", [float(-x) for x in donors[0]])]
    vectors = spark.createDataFrame(rows, "unit string, vec array<double>")
    targets = spark.createDataFrame([("near",), ("none",)], "unit string")
    barred = spark.createDataFrame([("near", "none"), ("none", "near")], "target string, excluded string")
    found = fit_weights(vectors, targets, barred, (0.5,), 5, 3).collect()
    assert {r["target"] for r in found} == {"near"} and all(r["weight"] > 0 for r in found)
