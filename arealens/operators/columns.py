"""Column selection, naming and recoding across a whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealens.functions import row_sum


def quoted(name: str) -> Column:
    """Column by literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def rename(df: DataFrame, names: Mapping[str, str] | Callable[[str], str] | Sequence[str]) -> DataFrame:
    """Rename by mapping, by function, or by position."""
    if callable(names):
        return df.toDF(*[names(c) for c in df.columns])
    if isinstance(names, Mapping):
        return df.withColumnsRenamed(dict(names))
    return df.toDF(*names)


def columns_where(df: DataFrame, *fragments: str) -> list[str]:
    """Names of the columns that hold all of these fragments."""
    return [c for c in df.columns if all(f in c for f in fragments)]


def sum_columns_where(df: DataFrame, sums: Mapping[str, Iterable[str]]) -> DataFrame:
    """Add one row sum per entry, over the columns whose name holds all its fragments."""
    added = {}
    for name, fragments in sums.items():
        found = columns_where(df, *fragments)
        added[name] = row_sum([quoted(c) for c in found]) if found else F.lit(0)
    return df.withColumns(added)


def flatten_names(names: Iterable[tuple[object, ...]], separator: str = "_") -> list[str]:
    """Flat column names from two-level ones."""
    return [separator.join(str(part) for part in name).strip(separator) for name in names]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def unpack_array(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Replace an array column by one column per element."""
    parts = [F.get(F.col(column), F.lit(i)).alias(name) for i, name in enumerate(names)]
    return df.select(*[c for c in df.columns if c != column], *parts)


def to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str, value: str
) -> DataFrame:
    """Wide to long: one row per (row, value column)."""
    return df.unpivot(list(ids), list(values), variable, value)
