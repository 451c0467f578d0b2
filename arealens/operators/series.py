"""Daily series: rolling means, rates and monthly quantile features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealens.functions import month_of, month_start, null_safe_sum, rate_per

from .quantiles import exact_quantiles, quantile_aggregates, quantile_columns, quantile_specs
from .relational import join_on


def daily_totals(df: DataFrame, unit: str, date: str, value: str | None = None, name: str = "value") -> DataFrame:
    """One row per unit and day: a sum, or a count of rows when no value is given.

    Everything a day holds is combined map-side, so later windows see at most one row per
    unit and calendar day.
    """
    total = F.count(F.lit(1)) if value is None else null_safe_sum(value)
    return (
        df.select(F.col(unit), F.col(date).cast("date").alias("date"), *([value] if value else []))
        .dropna(subset=[unit, "date"])
        .groupBy(unit, "date")
        .agg(total.alias(name))
    )


def complete_days(daily: DataFrame, unit: str, value: str, date: str = "date") -> DataFrame:
    """(unit, date, value) for every unit and every day of the table's span; days without a row count 0.

    Each unit's days are written out from the first and last day of the whole table, so the
    result has a row per unit and calendar day and nothing is multiplied but that.
    """
    low, high = daily.agg(F.min(date), F.max(date)).first()
    days = F.explode(F.sequence(F.lit(low).cast("date"), F.lit(high).cast("date"))).alias(date)
    frame = daily.select(unit).distinct().select(unit, days)
    return frame.join(daily.select(unit, date, value), [unit, date], "left").fillna(0, [value])


def rolling_mean(
    daily: DataFrame, unit: str, date: str, value: str, name: str, rows: int = 7
) -> DataFrame:
    """Trailing mean over the last ``rows`` rows of each unit, null until they are all there.

    Rows are counted, not days: gaps do not reset the frame. The input holds one row per
    unit and date, so a window partition is bounded by the length of the calendar; use
    ``daily_totals`` first on anything finer.
    """
    frame = Window.partitionBy(unit).orderBy(date).rowsBetween(-(rows - 1), 0)
    full = F.count(value).over(frame) == rows
    return daily.withColumn(name, F.when(full, F.avg(value).over(frame)))


def rolling_rate(
    daily: DataFrame,
    population: DataFrame,
    keys: Mapping[str, str],
    date: str,
    value: str,
    pop: str,
    rows: int = 7,
    per: float = 100_000.0,
    start: str | None = None,
) -> DataFrame:
    """Rolling mean and its rate per population, from ``start`` on.

    The cut in time comes after the rolling mean, which still sees the earlier rows.
    """
    (unit, _), = keys.items()
    joined = join_on(daily, population, keys)
    rolled = rolling_mean(joined, unit, date, value, "rolling_mean", rows)
    rated = rolled.withColumn("rolling_rate", rate_per("rolling_mean", pop, per))
    return rated.filter(F.col(date) >= F.lit(start).cast("date")) if start else rated


def monthly_features(
    series: DataFrame,
    unit: str,
    date: str,
    value: str,
    qs: Mapping[str, float] | None = None,
    month_of_year: bool = False,
    with_mean: bool = False,
    strategy: str = "percentile",
) -> DataFrame:
    """Quantiles (and the mean) of a series per unit and month, missing values skipped.

    Months are calendar months; ``month_of_year`` merges the same month of all years. A
    group is the days of a month, so plain ``percentile`` is safe.
    """
    qs = qs or {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    key = month_of(date) if month_of_year else month_start(date)
    keyed = series.withColumn("month", key)
    specs = quantile_specs([value], qs)
    if with_mean and strategy == "percentile":  # one aggregation for both
        mean = F.avg(value).alias(f"{value}_mean")
        grouped = keyed.dropna(subset=[unit, "month"]).groupBy(unit, "month").agg(*quantile_aggregates(specs), mean)
        return grouped.select(unit, "month", *quantile_columns(specs), f"{value}_mean")
    features = exact_quantiles(keyed, [unit, "month"], specs, strategy)
    if not with_mean:
        return features
    means = keyed.groupBy(unit, "month").agg(F.avg(value).alias(f"{value}_mean"))
    return features.join(means, [unit, "month"])


def features_long(features: DataFrame, unit: str, columns: Sequence[str]) -> DataFrame:
    """(unit, month, feature, value), one row per monthly feature."""
    return features.unpivot([unit, "month"], list(columns), "feature", "value")
