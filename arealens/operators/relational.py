"""Joins, lookups, first rows, calendars and samples.

No join carries a broadcast hint. Spark broadcasts a side only below
``spark.sql.autoBroadcastJoinThreshold``, measured at run time under adaptive execution,
and splits skewed partitions of the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_on(
    left: DataFrame, right: DataFrame, keys: Mapping[str, str] | Sequence[str] | str, how: str = "inner"
) -> DataFrame:
    """Equi-join on keys of the same name, or on differing names given as {left: right}.

    With differing names the right-hand keys are dropped from the result. Null keys never
    match.
    """
    if isinstance(keys, Mapping):
        if how in ("left_semi", "left_anti"):
            right = right.select(*[F.col(f"`{r}`") for r in keys.values()])
        renamed = right.withColumnsRenamed({r: l for l, r in keys.items()})
        return left.join(renamed, list(keys), how)
    return left.join(right, [keys] if isinstance(keys, str) else list(keys), how)


def star_join(fact: DataFrame, *dimensions: tuple[DataFrame, Mapping[str, str] | Sequence[str] | str]) -> DataFrame:
    """Inner joins of a fact table with each (dimension, keys) in turn."""
    return reduce(lambda left, item: join_on(left, item[0], item[1]), dimensions, fact)


def only_in(df: DataFrame, listed: DataFrame, keys: Mapping[str, str] | Sequence[str] | str) -> DataFrame:
    return join_on(df, listed, keys, "left_semi")


def not_in(df: DataFrame, listed: DataFrame, keys: Mapping[str, str] | Sequence[str] | str) -> DataFrame:
    return join_on(df, listed, keys, "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first whole row of each key; ``order`` should end in a unique column.

    An aggregate rather than a window: each map task forwards one row per key, so a hot
    key costs no more than any other.
    """
    sort_key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
    grouped = df.groupBy(*keys).agg(F.min_by(row, sort_key).alias("_row"))
    return grouped.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def calendar(df: DataFrame, date: str, step: str = "day", name: str = "date") -> DataFrame:
    """Every day, or every month start, between the first and last date of a table.

    A month calendar starts with the first month start inside the range.
    """
    low, high = F.min(date).cast("date"), F.max(date).cast("date")
    if step == "month":
        floor = F.trunc(low, "month")
        low = F.when(floor < low, F.add_months(floor, 1)).otherwise(floor)
    bounds = df.agg(low.alias("low"), high.alias("high")).filter(F.col("low") <= F.col("high"))
    days = F.sequence("low", "high", F.expr(f"interval 1 {step}"))
    return bounds.select(F.explode(days).alias(name))


def sample_units(df: DataFrame, unit: str, n: int, seed: int) -> DataFrame:
    """A seeded sample of ``n`` distinct units, without replacement.

    Ordering by a hash keeps the draw the same whatever the partitioning is.
    """
    draw = F.md5(F.concat_ws(":", F.col(unit).cast("string"), F.lit(str(seed))))
    return df.select(unit).distinct().orderBy(draw, unit).limit(n)
