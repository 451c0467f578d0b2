"""Standardisation, feature weights, noise and feature groups."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each column, from one aggregate.

    The job hands two numbers per column to the driver, however long the table is.
    """
    row = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"mean_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"sd_{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"mean_{i}"], row[f"sd_{i}"]) for i, c in enumerate(columns)}


def zscore(
    df: DataFrame,
    columns: Sequence[str],
    weights: Mapping[str, float] | None = None,
    moments: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Standardise columns over all rows, with the population standard deviation.

    A constant column is only centred. ``weights`` scales chosen columns afterwards. The
    moments are fitted here unless given, and enter the plan as literals: no window over
    all rows, no join.
    """
    weights = weights or {}
    moments = moments or column_moments(df, columns)

    def scaled(c: str) -> Column:
        mean, sd = moments[c]
        if mean is None:
            return F.lit(None).cast("double")
        z = (F.col(c) - F.lit(float(mean))) / F.lit(float(sd) or 1.0)
        return z * F.lit(float(weights[c])) if c in weights else z

    return df.withColumns({c: scaled(c) for c in columns})


def gaussian(key: Column | str, seed: int, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Normal noise that depends only on the row's key and the seed.

    Unlike ``randn`` the value survives a recomputed or repartitioned task.
    """
    text = (F.col(key) if isinstance(key, str) else key).cast("string")

    def uniform(salt: str) -> Column:
        digest = F.md5(F.concat_ws(":", text, F.lit(str(seed)), F.lit(salt)))
        bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
        return (bits + 0.5) / F.lit(float(16**13))

    unit = F.sqrt(-2 * F.log(uniform("r"))) * F.cos(F.lit(2 * math.pi) * uniform("a"))
    return F.lit(mean) + F.lit(sd) * unit


def resolve_features(
    chosen: Sequence[str], groups: Mapping[str, Sequence[str]], noise: str = "noise"
) -> list[str]:
    """Columns of the chosen feature groups; with none chosen, only the noise column."""
    unknown = [g for g in chosen if g not in groups]
    if unknown:
        raise ValueError(f"unknown feature groups: {unknown}")
    columns = [c for name, members in groups.items() if name in chosen for c in members]
    return columns or [noise]


def percent_explained(explained: Sequence[float], k: int) -> float:
    """Percent of the variance kept by the first ``k`` components."""
    return round(100 * float(sum(explained[:k])), 1)
