"""All workload queries; importing the modules registers them."""

from __future__ import annotations

from . import (  # noqa: F401
    control_queries,
    profile_queries,
    relational_queries,
    series_queries,
    table_queries,
)
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
