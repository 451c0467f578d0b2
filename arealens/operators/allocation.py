"""Spreading parent totals over children."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealens.functions import round_even
from arealens.functions.numeric import ratio


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``value`` as a share of its group's total.

    The totals are aggregated map-side and joined back, so a huge group is never gathered
    in one task as a window would do.
    """
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    joined = df.join(totals, list(keys))
    return joined.withColumn(name, ratio(value, "_total")).drop("_total")


def allocate_to_children(
    totals: DataFrame,
    bridge: DataFrame,
    parent: str,
    value: str,
    weight: str,
    name: str,
    digits: int | None = 2,
) -> DataFrame:
    """Parent totals times each child's share of its parent's weight, rounded half-even.

    ``bridge`` has one row per child with its parent and weight; ``totals`` may hold several
    rows per parent (per season or day). Parents without children and children without a
    parent disappear; a parent whose weights are all zero gives null.
    """
    parents = bridge.groupBy(parent).agg(F.sum(weight).alias("_parent_weight"))
    children = bridge.join(parents, parent)
    amount = ratio(F.col(value) * F.col(weight), "_parent_weight")
    spread = totals.join(children, parent).withColumn(
        name, amount if digits is None else round_even(amount, digits)
    )
    return spread.drop("_parent_weight")
