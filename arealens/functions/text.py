"""String expressions."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ColumnLike, as_column


def drop_last_char(value: ColumnLike) -> Column:
    """Everything but the last character; an empty string stays empty."""
    text = as_column(value)
    return F.substring(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0)))


def short_key(value: ColumnLike, length: int = 13) -> Column:
    """Stable short key: the first hex digits of the MD5 of the UTF-8 text."""
    return F.substring(F.md5(as_column(value)), 1, length)


def recode(value: ColumnLike, mapping: Mapping, otherwise: str = "self") -> Column:
    """Replace values by a fixed mapping.

    ``otherwise="self"`` keeps unmapped values, ``"null"`` drops them to null. The mapping
    is a literal in the plan, so no join and no shuffle is needed.
    """
    key = as_column(value)
    pairs = list(chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    mapped = F.try_element_at(F.create_map(*pairs), key)
    return F.coalesce(mapped, key) if otherwise == "self" else mapped
