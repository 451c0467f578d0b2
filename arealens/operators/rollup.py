"""Roll-ups to a coarser unit, and pivots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealens.functions import null_safe_sum, weighted_mean

from .columns import numeric_columns
from .quantiles import (
    HEAVY_ROWS,
    exact_quantiles,
    heavy_groups,
    quantile_aggregates,
    quantile_columns,
    quantiles_with_heavy,
)
from .relational import join_on


def rollup_units(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Mapping[str, str],
    quantiles: Mapping[str, tuple[str, float]] | None = None,
    strategy: str = "auto",
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Mixed aggregate per unit: {column: "sum" | "mean" | "median"} plus exact quantiles.

    One shuffle when every unit is small enough for ``percentile``; otherwise sums and
    means are combined map-side and the quantiles of the heavy units are ranked by
    ranges. Rows with a null key are dropped, and an all-null sum is 0.
    """
    rows = df.dropna(subset=list(keys))
    build = {"sum": null_safe_sum, "mean": F.avg}
    plain = {c: build[how](c).alias(c) for c, how in aggregates.items() if how != "median"}
    specs = {c: (c, 0.5) for c, how in aggregates.items() if how == "median"} | dict(quantiles or {})
    order = [*keys, *aggregates, *(quantiles or {})]
    if not specs:
        return rows.groupBy(*keys).agg(*plain.values()).select(*order)
    heavy = heavy_groups(rows, keys, heavy_rows) if strategy == "auto" else None
    if strategy == "percentile" or (heavy is not None and heavy.isEmpty()):
        grouped = rows.groupBy(*keys).agg(*plain.values(), *quantile_aggregates(specs))
        return grouped.select(*keys, *plain, *quantile_columns(specs)).select(*order)
    if heavy is None:
        ranked = exact_quantiles(rows, keys, specs, "split")
    else:
        ranked = quantiles_with_heavy(rows, keys, specs, heavy)
    if not plain:
        return ranked.select(*order)
    return rows.groupBy(*keys).agg(*plain.values()).join(ranked, list(keys)).select(*order)


def sum_all_numeric(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grouped sum of every numeric column, as found in the schema."""
    rows = df.dropna(subset=list(keys))
    return rows.groupBy(*keys).agg(
        *[null_safe_sum(F.col(f"`{c}`")).alias(c) for c in numeric_columns(df, keys)]
    )


def rollup_through(
    df: DataFrame,
    lookup: DataFrame,
    on: Mapping[str, str] | Sequence[str],
    keys: Sequence[str],
    aggregates: Mapping[str, str],
) -> DataFrame:
    """Second-level roll-up: attach the parent by a lookup, then aggregate."""
    return rollup_units(join_on(df, lookup, on), keys, aggregates)


def weighted_means(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: str
) -> DataFrame:
    """Weighted mean of several columns per group; rows missing any value are skipped."""
    rows = df.dropna(subset=[*keys, weight])
    return rows.groupBy(*keys).agg(
        *[
            weighted_mean(c, F.when(F.col(c).isNotNull(), F.col(weight))).alias(c)
            for c in columns
        ]
    )


def _pivot(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, cell: list[Column]) -> DataFrame:
    return df.dropna(subset=list(rows)).groupBy(*rows).pivot(column, list(values)).agg(*cell)


def pivot_unique(
    df: DataFrame, rows: Sequence[str], column: str, values: Sequence, value: str
) -> DataFrame:
    """Pivot whose cells hold at most one row; a duplicate cell raises when evaluated.

    The column values are given, which fixes the column order and saves a job.
    """
    single = F.when(
        F.count(F.lit(1)) > 1,
        F.raise_error(F.lit(f"duplicate cell in pivot of {column}")).cast(df.schema[value].dataType),
    ).otherwise(F.max(value))
    # checked per cell before the pivot, where the duplicates can still be seen
    cells = df.groupBy(*rows, column).agg(single.alias(value))
    return _pivot(cells, rows, column, values, [F.first(value, ignorenulls=True)])


def pivot_mean(
    df: DataFrame, rows: Sequence[str], column: str, values: Sequence, columns: Sequence[str]
) -> DataFrame:
    """Pivot with the mean of several columns, named ``<pivot value>_<column>``."""
    wide = _pivot(df, rows, column, values, [F.avg(c).alias(c) for c in columns])
    # Spark leaves the column name out when there is only one
    return wide.toDF(*rows, *[f"{v}_{c}" for v in values for c in columns])
