"""Joins of dates or numbers with a table of half-open intervals.

Intervals are sorted into classes by length: those of a class are more than half as long as
its bucket and at most as long, so each touches two buckets. A row looks up its own bucket in
every class, an equi-join, and the exact bounds are checked on what it finds there. Neither side need be
small, and no row meets an interval far from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(value: Column, df: DataFrame) -> Column:
    """Days of a date, microseconds of a timestamp, or the number itself."""
    kind = df.select(value.alias("v")).schema["v"].dataType.typeName()
    if kind == "date":
        return F.unix_date(value).cast("long")
    if kind == "timestamp":
        return F.unix_micros(value)
    if kind == "timestamp_ntz":
        second = (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("long")
        return F.unix_date(value.cast("date")).cast("long") * 86_400_000_000 + (F.hour(value) * 60 + F.minute(value)).cast("long") * 60_000_000 + second
    return value


def _bucketed(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Adds _from, _to, _class and one row per bucket touched; those that are empty or lack a bound go."""
    rows = intervals.withColumns({"_from": _number(F.col(start), intervals), "_to": _number(F.col(end), intervals)})
    rows = rows.where(F.col("_from") < F.col("_to"))
    size = F.greatest(F.ceil(F.col("_to") - F.col("_from")), F.lit(1)).cast("long")
    rows = rows.withColumn("_class", F.length(F.bin(size - 1)) * (size > 1).cast("int"))
    first, last = _bucket(F.col("_from"), F.col("_class")), _bucket(F.ceil(F.col("_to")) - 1, F.col("_class"))
    return rows.withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def _bucket(value: Column, by: Column | int) -> Column:
    by = F.lit(by) if isinstance(by, int) else by
    return F.call_function("shiftright", F.floor(value).cast("long"), by)


def _classes(bucketed: DataFrame) -> list[int]:
    return sorted(r[0] for r in bucketed.select("_class").distinct().collect())  # one per power of two: 64 at most


def interval_join(df: DataFrame, at: str, intervals: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Every row of ``df`` with every interval [start, end) that holds its value ``at``.

    All columns of both sides come out, so they must differ in name. Rows with a null value match
    nothing, nor do intervals with a null or reversed bound. Both sides may be of any size; the
    rows of ``df`` are looked up once per class of lengths the intervals have.
    """
    bucketed = _bucketed(intervals, start, end)
    levels = _classes(bucketed)
    rows = df.withColumn("_at", _number(F.col(at), df)).where("_at is not null")
    rows = rows.withColumn("_class", F.explode(F.array(*[F.lit(c) for c in levels]).cast("array<int>")))
    rows = rows.withColumn("_bucket", _bucket(F.col("_at"), F.col("_class")))
    met = rows.join(bucketed, ["_class", "_bucket"]).where((F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col("_to")))
    return met.select(*df.columns, *intervals.columns)


def overlapping(intervals: DataFrame, name: str, start: str = "start", end: str = "end") -> DataFrame:
    """(first, second): pairs of intervals of different names that overlap.

    Of two that do, one holds the other's start, so starts are joined with intervals. Names that stand
    for one interval meet each pair once; only pairs with a name of several have copies to remove.
    """
    known = intervals.where(F.col(name).isNotNull() & (F.col(start) < F.col(end))).select(F.col(name).alias("_name"), start, end).distinct()
    counts = known.groupBy("_name").agg((F.count(F.lit(1)) > 1).alias("_more"))
    if counts.where("_more").isEmpty():
        return _overlaps(known, known, start, end)
    marked = known.join(counts, "_name")
    once, several = marked.where(~F.col("_more")).drop("_more"), marked.where("_more").drop("_more")
    repeated = _overlaps(known, several, start, end).unionByName(_overlaps(several, once, start, end))
    return _overlaps(once, once, start, end).unionByName(repeated.distinct())


def _overlaps(starts: DataFrame, intervals: DataFrame, start: str, end: str) -> DataFrame:
    """(first, second): ``second`` of ``starts`` begins within ``first`` of ``intervals``."""
    # both sides are of the same kind of size: neither is broadcast on a guess from the files behind it
    starts = starts.select(F.col("_name").alias("second"), F.col(start).alias("_s")).hint("merge")
    met = interval_join(starts, "_s", intervals.select(F.col("_name").alias("first"), start, end), start, end)
    return met.where(F.col("first") != F.col("second")).select("first", "second")


def label_by_interval(
    df: DataFrame, at: str, intervals: DataFrame, name: str, label: str, start: str = "start", end: str = "end", other: str | None = None, check: bool = True
) -> DataFrame:
    """``df`` with the name of the interval that holds each row's value, else ``other``.

    One left join per class of lengths, each row staying one row. With ``check`` overlapping intervals
    raise a ValueError that names two of them; without, the rows of an overlap take a name of the
    shortest class that holds them, and repeat when that class holds several.
    """
    if check and (clash := overlapping(intervals, name, start, end).first()) is not None:
        raise ValueError(f"intervals {clash['first']!r} and {clash['second']!r} overlap")
    bucketed = _bucketed(intervals.select(F.col(name).alias("_name"), start, end), start, end)
    rows, found = df.withColumn("_at", _number(F.col(at), df)), []
    for i, c in enumerate(_classes(bucketed)):
        part = bucketed.where(F.col("_class") == c).select(
            F.col("_bucket").alias(f"_b{i}"), F.col("_from").alias(f"_f{i}"), F.col("_to").alias(f"_t{i}"), F.col("_name").alias(f"_n{i}")
        )
        holds = (_bucket(F.col("_at"), c) == F.col(f"_b{i}")) & (F.col(f"_f{i}") <= F.col("_at")) & (F.col("_at") < F.col(f"_t{i}"))
        rows = rows.join(part, holds, "left")
        found.append(F.col(f"_n{i}"))
    fallback = [F.lit(other)] if other is not None else []
    value = reduce(lambda a, b: F.coalesce(a, b), [*found, *fallback]) if found or fallback else F.lit(None).cast("string")
    return rows.select(*df.columns, value.alias(label))
