"""What-if analysis: a random forest, shifted inputs, and effects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import islice

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.functions import is_weekend, month_of

from .relational import join_on

#: Scenarios of a table that one pass over the panel carries.
SCENARIOS_AT_ONCE = 256


def daily_panel(
    moving: DataFrame,
    response: DataFrame,
    keys: Sequence[str],
    date: str,
    static: DataFrame | None = None,
    static_keys: Mapping[str, str] | None = None,
) -> DataFrame:
    """Time-varying inputs with their response, calendar features and static features."""
    panel = join_on(moving, response, keys).withColumns(
        {date: F.col(date).cast("date")}
    ).withColumns({"ymonth": month_of(date), "is_weekend": is_weekend(date)})
    return panel if static is None else join_on(panel, static, static_keys)


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    response: str,
    trees: int = 20,
    depth: int = 6,
    seed: int = 0,
    bins: int = 256,
) -> RandomForestRegressionModel:
    """Random-forest regression on the rows without nulls, all features tried per split.

    Splits are sought among ``bins`` quantile bins per feature, so trees grow from
    histograms summed over partitions.
    """
    assembled = VectorAssembler(inputCols=list(features), outputCol="features").transform(
        df.select(*features, response).na.drop("any")
    )
    forest = RandomForestRegressor(
        labelCol=response,
        maxDepth=depth,
        numTrees=trees,
        seed=seed,
        featureSubsetStrategy="all",
        maxBins=bins,
    )
    return forest.fit(assembled.select("features", F.col(response).cast("double").alias(response)))


def feature_importances(
    model: RandomForestRegressionModel, features: Sequence[str], like: DataFrame
) -> DataFrame:
    """Features by falling importance."""
    rows = list(zip(features, model.featureImportances.toArray().tolist(), strict=True))
    table = like.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def predict(
    model: RandomForestRegressionModel,
    df: DataFrame,
    features: Sequence[str],
    name: str,
    shifts: Mapping[str, float] | None = None,
) -> DataFrame:
    """Add the model's prediction, optionally at shifted inputs; the inputs stay as they are."""
    shifts = shifts or {}
    inputs = {f"_in_{c}": F.col(c) + F.lit(float(shifts.get(c, 0.0))) for c in features}
    assembled = VectorAssembler(
        inputCols=list(inputs), outputCol="_inputs", handleInvalid="error"
    ).transform(df.withColumns(inputs))
    scorer = PipelineModel([model.copy().setFeaturesCol("_inputs").setPredictionCol(name)])
    return scorer.transform(assembled).drop("_inputs", *inputs)


def regression_metrics(df: DataFrame, actual: str, fitted: str) -> DataFrame:
    """Mean squared error, its root, and mean absolute error."""
    error = F.col(actual) - F.col(fitted)
    mse = F.avg(error * error)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(error)).alias("mae"))


def shift_columns(df: DataFrame, shifts: Mapping[str, float]) -> DataFrame:
    """One scenario: add a constant to each named column."""
    return df.withColumns({c: F.col(c) + F.lit(float(d)) for c, d in shifts.items()})


def apply_scenarios(
    df: DataFrame, scenarios: Mapping[str, Mapping[str, float]], name: str = "scenario"
) -> DataFrame:
    """One copy of the rows per named scenario, with its shifts applied.

    The scenarios are a literal array in the plan; each row is expanded where it is read.
    """
    columns = list(dict.fromkeys(c for shifts in scenarios.values() for c in shifts))
    entries = [
        F.struct(
            F.lit(label).alias("_name"),
            *[F.lit(float(shifts.get(c, 0.0))).alias(c) for c in columns],
        )
        for label, shifts in scenarios.items()
    ]
    copies = df.withColumn("_s", F.explode(F.array(*entries)))
    return copies.withColumns(
        {name: F.col("_s._name")} | {c: F.col(c) + F.col("_s")[c] for c in columns}
    ).drop("_s")


def scenario_effect(
    model: RandomForestRegressionModel,
    df: DataFrame,
    features: Sequence[str],
    response: str,
    shifts: Mapping[str, float],
    keys: Sequence[str],
) -> DataFrame:
    """Mean actual, expected and counterfactual value per key, and their difference.

    Both predictions are made in the same pass over the rows, so one aggregation replaces
    two aggregations and a join.
    """
    rows = df.na.drop("any", subset=[*features, response])
    scored = predict(model, rows, features, "expected")
    scored = predict(model, scored, features, "counterfactual", shifts)
    means = scored.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in (response, "expected", "counterfactual")]
    )
    return means.withColumn("effect", F.col("counterfactual") - F.col("expected"))


def scenario_table_effects(
    model: RandomForestRegressionModel,
    df: DataFrame,
    features: Sequence[str],
    response: str,
    scenarios: DataFrame,
    keys: Sequence[str],
    at_once: int = SCENARIOS_AT_ONCE,
) -> DataFrame:
    """``scenario_effect`` of every scenario of a table: (scenario, *keys, response, expected, counterfactual, effect).

    ``scenarios`` is long, (scenario, feature, shift); shifts of one feature add up, a null shift is
    none, and a scenario without any feature (a null one) shifts nothing. Expected values are predicted once per row, and the row is
    then expanded by the scenarios, so the panel is read once for every ``at_once`` of them.
    Means combine map-side: a task hands over one partial row per scenario and key.
    """
    unknown = scenarios.where(F.col("feature").isNotNull() & ~F.col("feature").isin(list(features))).first()
    if unknown is not None:
        raise ValueError(f"scenario {unknown['scenario']!r} shifts {unknown['feature']!r}, which is no input of the model")
    listed = scenarios.where("scenario is not null").groupBy("scenario", "feature").agg(F.sum("shift").alias("shift"))
    shifts = F.map_from_entries(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", F.coalesce("shift", F.lit(0.0))))))
    listed = listed.groupBy("scenario").agg(shifts.alias("shifts")).orderBy("scenario")
    rows = predict(model, df.na.drop("any", subset=[*features, response]), features, "expected")
    means = [F.avg(c).alias(c) for c in (response, "expected", "counterfactual")]
    parts, waiting = [], listed.toLocalIterator()
    while some := {r["scenario"]: r["shifts"] for r in islice(waiting, at_once)}:
        shifted = apply_scenarios(rows, some)
        scored = predict(model, shifted, features, "counterfactual").groupBy("scenario", *keys).agg(*means)
        parts.append(scored.withColumn("effect", F.col("counterfactual") - F.col("expected")))
    if not parts:
        raise ValueError("no scenario is given")
    return reduce(DataFrame.unionByName, parts)


#: Columns of a node table: inner nodes test ``feature`` <= ``threshold``; leaves carry ``value``.
NODE_SCHEMA = "tree int, leaf int, weight double, value double, bounds array<struct<feature:int,low:double,high:double>>"


def forest_leaves(model: RandomForestRegressionModel, like: DataFrame) -> DataFrame:
    """One row per leaf of every tree: (tree, leaf, weight, value, bounds).

    ``bounds`` are the conditions on the way to the leaf, low < feature <= high, one per feature
    that is tested. Every row of inputs meets exactly one leaf of each tree.
    """
    rows = []
    for tree, (one, weight) in enumerate(zip(model.trees, model.treeWeights)):
        todo, leaf = [(one._call_java("rootNode"), {})], 0
        while todo:
            node, box = todo.pop()
            if node.subtreeDepth() == 0:
                bounds = [(f, low, high) for f, (low, high) in sorted(box.items())]
                rows.append((tree, leaf, float(weight), float(node.prediction()), bounds))
                leaf += 1
                continue
            feature, cut = node.split().featureIndex(), node.split().threshold()
            low, high = box.get(feature, (float("-inf"), float("inf")))
            todo.append((node.leftChild(), box | {feature: (low, min(high, cut))}))
            todo.append((node.rightChild(), box | {feature: (max(low, cut), high)}))
    return like.sparkSession.createDataFrame(rows, NODE_SCHEMA)


def predict_by_leaves(df: DataFrame, leaves: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """Add the forest's prediction from its leaf table: the weighted mean of the leaves a row falls in.

    The leaves (at most trees x 2 ** depth) become an array in the plan, and the range
    conditions are tested where the row is read; no model object travels. Rows with a missing input get null.
    """
    inputs = F.array(*[F.col(c).cast("double") for c in features])
    held = leaves.agg(F.collect_list(F.struct("weight", "value", "bounds"))).scalar()
    total = leaves.agg(F.sum("weight") / F.count_distinct("leaf", "tree") * F.count_distinct("tree")).scalar()
    inside = lambda box: F.forall(
        box["bounds"], lambda b: (F.get("_x", b["feature"]) > b["low"]) & (F.get("_x", b["feature"]) <= b["high"])
    )
    rows = df.withColumn("_x", inputs).withColumn("_leaves", held)
    summed = F.aggregate(F.filter("_leaves", inside), F.lit(0.0), lambda a, b: a + b["weight"] * b["value"])
    known = F.forall("_x", lambda v: v.isNotNull())
    return rows.withColumn(name, F.when(known, summed / F.lit(1.0) / total)).drop("_x", "_leaves")


def mean_effect(effects: DataFrame, unit: str) -> DataFrame:
    return effects.groupBy(unit).agg(F.avg("effect").alias("effect"))
