"""Exact quantiles with linear interpolation, also for groups no single task could hold.

Spark's ``percentile`` is exact but keeps a value map per group in one task. Groups above a
size are ranked by narrowing the ranges of values that hold the wanted ranks instead: a
sketch cuts a range in buckets, small per-bucket counts say which bucket holds each rank, and
that is the next range, until no range has more distinct values than one task should order.
Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arealens.session import cut

HEAVY_ROWS = 2_000_000
SPLITS = 256
SORT_ROWS = 1 << 16  # distinct values of one range that a task orders

Specs = Mapping[str, tuple[str, float]]


def quantile_aggregates(specs: Specs) -> list[Column]:
    """One ``percentile`` per source column, as an array named after the column."""
    by_column: dict[str, list[float]] = {}
    for column, q in specs.values():
        by_column.setdefault(column, []).append(q)
    return [
        F.percentile(F.col(c).cast("double"), F.array(*[F.lit(q) for q in qs])).alias(f"_q_{c}")
        for c, qs in by_column.items()
    ]


def quantile_columns(specs: Specs) -> list[Column]:
    """Pick the result columns out of the arrays of ``quantile_aggregates``."""
    seen: dict[str, int] = {}
    picked = []
    for name, (column, _) in specs.items():
        position = seen.get(column, 0)
        seen[column] = position + 1
        picked.append(F.col(f"_q_{column}")[position].alias(name))
    return picked


def heavy_groups(df: DataFrame, keys: Sequence[str], heavy_rows: int) -> DataFrame:
    """Keys with more than ``heavy_rows`` rows: at most rows / heavy_rows of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > heavy_rows).select(*keys)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    specs: Specs,
    strategy: str = "auto",
    heavy_rows: int = HEAVY_ROWS,
    sort_rows: int = SORT_ROWS,
) -> DataFrame:
    """Quantiles per group; ``specs`` maps a result name to (column, q).

    ``keys`` may be empty for one global group. Nulls are skipped and null keys dropped.
    ``strategy`` is "percentile" (groups known to be small), "split" (every group is
    ranked by ranges) or "auto", which counts the groups first and splits the heavy ones.
    Where groups are split no task orders more than ``sort_rows`` distinct values at once.
    """
    if not keys:
        whole = df.withColumn("_all", F.lit(1))
        return exact_quantiles(whole, ["_all"], specs, strategy, heavy_rows, sort_rows).drop("_all")
    columns = list(dict.fromkeys(c for c, _ in specs.values()))
    rows = df.select(*keys, *columns).dropna(subset=list(keys))
    if strategy == "percentile":
        return _by_percentile(rows, keys, specs)
    if strategy == "split":
        return _by_split(rows, keys, specs, sort_rows)
    heavy = heavy_groups(rows, keys, heavy_rows)
    if heavy.isEmpty():
        return _by_percentile(rows, keys, specs)
    return quantiles_with_heavy(rows, keys, specs, heavy, sort_rows)


def quantiles_with_heavy(
    rows: DataFrame, keys: Sequence[str], specs: Specs, heavy: DataFrame, sort_rows: int = SORT_ROWS
) -> DataFrame:
    """Quantiles when ``heavy`` lists the groups too big for one task."""
    light_part = _by_percentile(rows.join(heavy, list(keys), "left_anti"), keys, specs)
    heavy_part = _by_split(rows.join(heavy, list(keys), "left_semi"), keys, specs, sort_rows)
    return light_part.unionByName(heavy_part)


def _by_percentile(rows: DataFrame, keys: Sequence[str], specs: Specs) -> DataFrame:
    grouped = rows.groupBy(*keys).agg(*quantile_aggregates(specs))
    return grouped.select(*keys, *quantile_columns(specs))


def _inside(counts: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    return counts.join(ranges, group).filter(F.col("_x").between(F.col("_lo"), F.col("_hi")))


def _narrowed(counts: DataFrame, ranges: DataFrame, group: list[str], sort_rows: int) -> DataFrame:
    """Ranges of more than ``sort_rows`` values replaced by their buckets that hold wanted ranks."""
    wide = ranges.filter(F.col("_rows") > sort_rows)
    one = [*group, "_lo"]
    rows = _inside(counts, wide.select(*one, "_hi"), group)
    steps = F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])
    cuts = rows.groupBy(*one).agg(
        F.array_distinct(F.percentile_approx("_x", steps, 10 * SPLITS)).alias("_cuts")
    )
    # every 16th cut point, to look a value up in two short steps
    sixteenths = F.filter("_cuts", lambda c, i: i % 16 == 15)
    bucketed = rows.join(cuts.withColumn("_coarse", sixteenths), one)
    # a value's bucket is the number of cut points below it
    passed = 16 * F.size(F.filter("_coarse", lambda c: c < F.col("_x")))
    rest = F.size(F.filter(F.slice("_cuts", F.col("_passed") + 1, 16), lambda c: c < F.col("_x")))
    bucketed = bucketed.withColumn("_passed", passed).withColumn("_bucket", F.col("_passed") + rest)
    # at most SPLITS rows per range from here on
    sizes = bucketed.groupBy(*one, "_bucket").agg(
        F.sum("_n").alias("_size"),
        F.count("_x").alias("_values"),
        F.min("_x").alias("_low"),
        F.max("_x").alias("_high"),
    )
    ordered = Window.partitionBy(*one).orderBy("_bucket")
    placed = sizes.join(wide.drop("_hi", "_rows"), one).withColumn(
        "_end", F.col("_start") + F.sum("_size").over(ordered)
    )
    begin = F.col("_end") - F.col("_size")
    held = F.filter("_ranks", lambda r: (r >= begin) & (r < F.col("_end")))
    narrow = placed.select(
        *group,
        "_total",
        begin.alias("_start"),
        held.alias("_ranks"),
        F.col("_low").alias("_lo"),
        F.col("_high").alias("_hi"),
        F.col("_values").alias("_rows"),
    ).filter(F.size("_ranks") > 0)
    return ranges.filter(F.col("_rows") <= sort_rows).unionByName(narrow)


def _by_split(
    rows: DataFrame, keys: Sequence[str], specs: Specs, sort_rows: int = SORT_ROWS
) -> DataFrame:
    columns = list(dict.fromkeys(c for c, _ in specs.values()))
    group = [*keys, "_var"]
    long = rows.withColumns({c: F.col(c).cast("double") for c in columns}).unpivot(
        list(keys), columns, "_var", "_x"
    )
    # equal values collapse before anything is ranked, so a repeated value is one row; read
    # several times below, so the rows themselves are scanned only once
    counts = cut(long.groupBy(*group, "_x").agg(F.count(F.lit(1)).alias("_n")))
    known = counts.filter(F.col("_x").isNotNull())

    def wanted_ranks(column: str, qs: list[float]) -> Column:
        position = [(F.col("_total") - 1) * F.lit(q) for q in qs]
        ranks = [F.floor(p) for p in position] + [F.ceil(p) for p in position]
        return F.when(F.col("_var") == column, F.array_distinct(F.array(*ranks)))

    by_column = {c: [q for v, q in specs.values() if v == c] for c in columns}
    ranks = F.coalesce(*[wanted_ranks(c, qs) for c, qs in by_column.items()])
    # a range of values with the ranks wanted in it and the number of rows below it
    ranges = (
        known.groupBy(*group)
        .agg(
            F.sum("_n").alias("_total"),
            F.min("_x").alias("_lo"),
            F.max("_x").alias("_hi"),
            F.count("_x").alias("_rows"),
        )
        .select(
            *group, "_total", F.lit(0).cast("long").alias("_start"), ranks.alias("_ranks"), "_lo", "_hi", "_rows"
        )
    )
    while (ranges.agg(F.max("_rows")).first()[0] or 0) > sort_rows:
        ranges = cut(_narrowed(known, ranges, group, sort_rows))
    within = Window.partitionBy(*group, "_lo").orderBy("_x")
    hits = (
        _inside(known, ranges, group)
        .withColumn("_upto", F.col("_start") + F.sum("_n").over(within))
        .withColumn(
            "_hit",
            F.filter(
                "_ranks",
                lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")),
            ),
        )
        .filter(F.size("_hit") > 0)
    )
    # a handful of (rank, value) pairs per group
    found = hits.select(*group, "_total", "_x", F.explode("_hit").alias("_rank"))
    lookup = found.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws(":", "_var", "_rank"), F.col("_x")))
        ).alias("_at"),
        F.map_from_entries(F.collect_set(F.struct("_var", "_total"))).alias("_totals"),
    )

    def interpolated(column: str, q: float) -> Column:
        position = (F.try_element_at("_totals", F.lit(column)) - 1) * F.lit(q)
        low, high = F.floor(position), F.ceil(position)
        at_low, at_high = (
            F.try_element_at("_at", F.concat(F.lit(f"{column}:"), r.cast("string")))
            for r in (low, high)
        )
        # the weights of percentile, so both ways agree to the last bit
        mixed = (high - position) * at_low + (position - low) * at_high
        return F.when(low == high, at_low).otherwise(mixed)

    result = lookup.select(*keys, *[interpolated(c, q).alias(n) for n, (c, q) in specs.items()])
    # groups whose values are all null still get a row
    return counts.select(*keys).distinct().join(result, list(keys), "left")


def exact_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], **options) -> DataFrame:
    return exact_quantiles(df, keys, {c: (c, 0.5) for c in columns}, **options)


def quantile_specs(columns: Sequence[str], qs: Mapping[str, float]) -> dict[str, tuple[str, float]]:
    """Specs named ``<column>_<suffix>`` for several columns and quantiles."""
    return {f"{c}_{suffix}": (c, q) for c in columns for suffix, q in qs.items()}

