"""Arithmetic with the null, zero and rounding rules of the library.

Rules: a missing addend counts as 0, a zero denominator gives null, and rounding is
half-to-even.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def round_even(value: ColumnLike, digits: int = 0) -> Column:
    """Round half to even on the scaled binary value, as numpy does."""
    scale = float(10**digits)
    return F.rint(as_column(value) * F.lit(scale)) / F.lit(scale)


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Division that is null (not an error, not infinity) over zero."""
    return as_column(numerator).cast("double") / F.nullif(
        as_column(denominator).cast("double"), F.lit(0.0)
    )


def row_sum(columns: Iterable[ColumnLike]) -> Column:
    """Sum across columns of one row; nulls count as 0, so all-null gives 0."""
    return reduce(add, [F.coalesce(as_column(c), F.lit(0)) for c in columns])


def weighted_row_mean(
    columns: Sequence[ColumnLike], weights: Sequence[float], total: ColumnLike
) -> Column:
    """Dot product of a row with constant weights over a total (mean age from bands)."""
    terms = [as_column(c) * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)]
    return ratio(reduce(add, terms), total)


def proportion(part: ColumnLike, total: ColumnLike, digits: int | None = None) -> Column:
    share = ratio(part, total)
    return share if digits is None else round_even(share, digits)


def density(
    population: ColumnLike,
    area: ColumnLike,
    digits: int | None = None,
    area_units_per_km2: float = 1.0,
) -> Column:
    """Population per km²; pass 1e6 when the area is in m²."""
    km2 = as_column(area).cast("double") / F.lit(float(area_units_per_km2))
    value = ratio(population, km2)
    return value if digits is None else round_even(value, digits)


def rate_per(value: ColumnLike, population: ColumnLike, per: float = 100_000.0) -> Column:
    return ratio(F.lit(float(per)) * as_column(value), population)


def spread(upper: ColumnLike, lower: ColumnLike) -> Column:
    """Inter-quantile range."""
    return as_column(upper) - as_column(lower)


def null_safe_sum(value: ColumnLike) -> Column:
    """Grouped sum where an all-null group gives 0."""
    return F.coalesce(F.sum(as_column(value)), F.lit(0))


def weighted_mean(value: ColumnLike, weight: ColumnLike) -> Column:
    """Grouped mean of ``value`` weighted by ``weight``; partial sums combine map-side."""
    return ratio(F.sum(as_column(value) * as_column(weight)), F.sum(as_column(weight)))


def planar_distance(x1: ColumnLike, y1: ColumnLike, x2: ColumnLike, y2: ColumnLike) -> Column:
    dx = as_column(x1) - as_column(x2)
    dy = as_column(y1) - as_column(y2)
    return F.sqrt(dx * dx + dy * dy)


def haversine_km(
    lat1: ColumnLike, long1: ColumnLike, lat2: ColumnLike, long2: ColumnLike
) -> Column:
    """Great-circle distance; the geographic alternative to ``planar_distance``."""
    phi1, phi2 = F.radians(as_column(lat1)), F.radians(as_column(lat2))
    half_lat = F.sin((phi2 - phi1) / 2)
    half_long = F.sin(F.radians(as_column(long2) - as_column(long1)) / 2)
    chord = half_lat * half_lat + F.cos(phi1) * F.cos(phi2) * half_long * half_long
    return F.lit(2 * 6371.0088) * F.asin(F.sqrt(chord))
