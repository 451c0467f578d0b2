"""Mix sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bits of the hash that make a uniform number; a double holds them exactly.
BITS = 52
#: Copies of a row that are listed at once.
BLOCK = 4096


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts: the same wherever and whenever it is computed."""
    head = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, BITS // 4)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(float(2**BITS))


def poisson_window(rate: Column) -> Column:
    """(first, steps): P(X <= k) for k = first, first + 1, ... where the distribution has its mass.

    Below and above the window lies less than any uniform number of BITS bits can tell, so it
    holds about 24 square roots of the rate. Each weight is its predecessor's times
    rate / k and the sums are divided by the last, so large rates neither underflow nor
    take logarithms of factorials. Null where the rate is not positive.
    """
    spread = 12 * F.sqrt(rate) + 30
    first = F.greatest(F.lit(0.0), F.floor(rate - spread).cast("double")).cast("long")
    last = F.ceil(rate + spread).cast("long")
    start = F.struct(
        F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("sums")
    )

    def add(acc: Column, k: Column) -> Column:
        weight = F.when(k == first, F.lit(1.0)).otherwise(acc["weight"] * rate / k)
        total = acc["sum"] + weight
        return F.struct(
            weight.alias("weight"), total.alias("sum"), F.concat(acc["sums"], F.array(total)).alias("sums")
        )

    steps = F.aggregate(
        F.sequence(first, last), start, add, lambda acc: F.transform(acc["sums"], lambda s: s / acc["sum"])
    )
    return F.when(rate > 0, F.struct(first.alias("first"), steps.alias("steps")))


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where no uniform number of BITS bits can pass it."""
    window = poisson_window(rate)
    return F.concat(F.array_repeat(F.lit(0.0), window["first"].cast("int")), window["steps"])


def repetition_rates(
    docs: DataFrame,
    weights: Mapping[str, float],
    other: float,
    budget: float | None,
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(source, rate): how often a document of each source repeats on average.

    The share of a source is its weight (``other`` where none is given) over the weights of all
    sources present; its rate is share x budget / bytes of the source. ``budget`` None takes
    the size of the corpus.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(
        F.sum(F.coalesce(F.octet_length(text_col), F.lit(0))).cast("double").alias("bytes")
    )
    weight = F.lit(float(other))
    for name, value in sorted(weights.items()):
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    sizes = stored(sizes.withColumn("weight", weight), "mix-sizes")
    all_weight, all_bytes = sizes.agg(F.sum("weight"), F.sum("bytes")).first()
    wanted = all_bytes if budget is None else float(budget)
    rate = F.try_divide(F.col("weight") * F.lit(wanted), F.lit(all_weight) * F.col("bytes"))
    return sizes.select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float],
    other: float = 1.0,
    budget: float | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with each row repeated so that sources reach their weights, in shuffled order.

    A row of a source with mean rate r is given k copies, k the inverse of the Poisson(r)
    distribution at a uniform number hashed from seed and id. Copies are exploded, and all
    rows are ordered by a second hash, which is the global shuffle: nothing depends on
    partitions or on the order of the input. A source costs time linear in its rate. Adds ``copy`` (0, 1, ...), ``n_copies`` and
    ``shuffle_key``.

    A null source counts as the empty name; a source without bytes or weight has rate 0 and
    goes. A null id hashes as its own value. Rows that repeat an id get the same number of
    copies. An empty table gives none. Columns of docs called like the added ones are replaced.
    """
    added = ("copy", "n_copies", "shuffle_key", "_source", "_window", "_block")
    kept = [c for c in docs.columns if c not in added]
    rates = repetition_rates(docs, weights, other, budget, source_col, text_col).select(
        F.col("source").alias("_source"), poisson_window(F.col("rate")).alias("_window")
    )
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    draw = uniform(F.lit(seed), name)
    counted = (
        docs.select(*kept, F.coalesce(F.col(source_col), F.lit("")).alias("_source"))
        .join(rates, "_source")
        .withColumn("n_copies", F.col("_window.first") + F.size(F.filter("_window.steps", lambda p: p < draw)))
        .where(F.col("n_copies") > 0)
    )
    end = F.col("n_copies") - 1
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), end, F.lit(BLOCK).cast("long"))))
    copies = blocks.withColumn("copy", F.explode(F.sequence("_block", F.least(F.col("_block") + (BLOCK - 1), end))))
    key = F.md5(F.concat_ws(":", F.lit(seed + 1).cast("string"), name, F.col("copy").cast("string")))
    return (
        copies.withColumn("shuffle_key", key)
        .select(*kept, "copy", "n_copies", "shuffle_key")
        .orderBy("shuffle_key", id_col, "copy")
    )
