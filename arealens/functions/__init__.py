"""Column expressions; all of them compile to JVM code."""

from .dates import in_period, is_weekend, month_of, month_start, season_of
from .numeric import (
    density,
    haversine_km,
    null_safe_sum,
    planar_distance,
    proportion,
    rate_per,
    round_even,
    row_sum,
    spread,
    weighted_mean,
    weighted_row_mean,
)
from .text import drop_last_char, recode, short_key

__all__ = [
    "density",
    "drop_last_char",
    "haversine_km",
    "in_period",
    "is_weekend",
    "month_of",
    "month_start",
    "null_safe_sum",
    "planar_distance",
    "proportion",
    "rate_per",
    "recode",
    "round_even",
    "row_sum",
    "season_of",
    "short_key",
    "spread",
    "weighted_mean",
    "weighted_row_mean",
]
