"""Date expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ColumnLike, as_column


def season_of(
    date: ColumnLike, seasons: Sequence[tuple[str, str, str]], other: str = "other_season"
) -> Column:
    """Name of the half-open period [from, to) that holds ``date``, else ``other``."""
    day = as_column(date)
    result = F.lit(other)
    for name, start, end in reversed(seasons):
        inside = (day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date"))
        result = F.when(inside, F.lit(name)).otherwise(result)
    return result


def is_weekend(date: ColumnLike) -> Column:
    return F.when(F.weekday(as_column(date)) > 4, 1).otherwise(0)


def month_of(date: ColumnLike) -> Column:
    """Month of the year, 1 to 12."""
    return F.month(as_column(date))


def month_start(date: ColumnLike) -> Column:
    return F.trunc(as_column(date), "month")


def in_period(date: ColumnLike, start: str | None = None, end: str | None = None) -> Column:
    """True from ``start`` on and before ``end``; either bound may be open."""
    day, result = as_column(date), F.lit(True)
    if start is not None:
        result = result & (day >= F.lit(start).cast("date"))
    if end is not None:
        result = result & (day < F.lit(end).cast("date"))
    return result
