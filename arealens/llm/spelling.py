"""Spelling variants: words one edit apart, found by dense comparison of blocks of words.

Two words are one insertion, deletion or replacement apart exactly when their common prefix and
common suffix together reach the longer one's length less one. Words that could be are brought
together by half a word they must then share; inside such a group all are compared at once, as
matrices of code points padded to one width, left-aligned for prefixes and right-aligned for
suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form has at least this many times the occurrences of the word it corrects.
FACTOR = 10
#: Members from which a group is divided by a longer shared part.
CROWD = 1024
#: Cells of a comparison tile.
CELLS = 1 << 21
GROUP = ["m", "a", "b", "bar", "stem"]
NO_BAR = 1 << 30


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = 31, least_length: int = 1) -> DataFrame:
    """(word, n) of all runs of at least ``least_length`` letters in whole texts, lower-cased (A-Z only).

    With ``slip`` every run whose crc32 of ``<id>:<run>`` it divides first loses the code point
    at that number modulo its length: typing errors of known origin. A null id counts as an empty string.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))).alias("run"))
    word = ascii_lower(F.col("run"))
    if slip is not None:
        runs = runs.select(word.alias("run"), F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), word)).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _part(word: Column, a: Column, b: Column) -> Column:
    """The first ``a`` and the last ``b`` code points of a word."""
    return F.concat(F.substring(word, F.lit(1), a), F.substring(word, F.length(word) - b + 1, b))


def _halved(level: DataFrame) -> DataFrame:
    """Every member of a group under the two groups that divide it.

    Members share ``a`` code points in front and ``b`` behind; the longer of two near ones has
    t = m - a - b between them. One edit leaves one half of those whole, so near members also share the
    next t // 2 in front or the t // 2 before the end. Pairs that share both count in front:
    ``bar`` is the common prefix from which a group behind leaves a pair to the other.
    """
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    steps = F.array(
        F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("bar").alias("bar")),
        F.struct(F.col("a").alias("a"), (F.col("b") + half).alias("b"), F.least("bar", F.col("a") + half).alias("bar")),
    )
    rows = level.select("m", "word", F.explode(steps).alias("s"))
    return rows.select("m", "s.a", "s.b", "s.bar", _part(F.col("word"), F.col("s.a"), F.col("s.b")).alias("stem"), "word")


def _groups(words: DataFrame, crowd: int) -> DataFrame:
    """(m, a, b, bar, stem, word): each word in every group where it may meet a near one.

    ``m`` is the length of the longer word of a pair, so each word goes with its own length and
    with the next. Groups above ``crowd`` members are divided until none is left, or until their members
    share all but one code point.
    """
    size = F.length("word")
    start = words.select(F.explode(F.array(size, size + 1)).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(NO_BAR).alias("bar"), "word")
    level, done = stored(_halved(start), "spelling-halves"), []
    while True:
        crowded = level.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("held")).where((F.col("held") > crowd) & (F.col("m") - F.col("a") - F.col("b") >= 2))
        crowded = stored(crowded.select(*GROUP), "spelling-crowded")
        if not crowded.head(1):
            break
        done.append(level.join(crowded, GROUP, "left_anti").select(*GROUP, "word"))
        level = stored(_halved(level.join(crowded, GROUP, "left_semi")), "spelling-halves")
    for part in done:
        level = level.select(*GROUP, "word").unionByName(part)
    return level


def near_in_block(left: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(near, common prefix) of all rows of two blocks of stacked groups.

    ``left`` is (groups, rows, width), zero-padded code points; ``other`` the same with its own
    rows. Equal words and padding rows (size -1) are near nothing.
    """
    shape = (left.shape[0], left.shape[1], other.shape[1])
    width = left.shape[2]
    prefix, suffix = np.zeros(shape, np.int16), np.zeros(shape, np.int16)
    for matrix, partner, total in ((left, other, prefix), (_right(left, sizes), _right(other, other_sizes), suffix)):
        run = np.ones(shape, bool)
        for c in range(width):
            mine = matrix[:, :, None, c]
            run &= (mine == partner[:, None, :, c]) & (mine != 0)
            if not run.any():
                break
            total += run
    a, b = sizes[:, :, None], other_sizes[:, None, :]
    longer = np.maximum(a, b)
    near = (np.minimum(a, b) >= longer - 1) & (prefix + suffix >= longer - 1) & ~((prefix == longer) & (a == b))
    return near & (a >= 0) & (b >= 0), prefix


def _right(matrix: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows turned round, so that suffixes are aligned."""
    at = sizes[..., None] - 1 - np.arange(matrix.shape[2])
    return np.where(at >= 0, np.take_along_axis(matrix, np.maximum(at, 0), axis=2), 0)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as a zero-padded matrix, and the words' sizes; U+0000 is told from padding."""
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    if not len(flat) or flat.max() < 256:
        flat = flat.astype(np.uint8)
    matrix = np.zeros((len(words), int(sizes.max(initial=0))), flat.dtype)
    matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = flat
    return matrix, sizes


def _pairs(words: list[str], group: np.ndarray, bars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (i, j), i before j, of words that come sorted by group."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    held = np.diff(np.append(first, len(group)))
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    matrix, sizes = _points(words)
    stack = 1 << np.ceil(np.log2(np.maximum(held, 1))).astype(int)  # groups of like size are one stack
    for side in np.unique(stack[held > 1]).tolist():
        starts, counts = first[(stack == side) & (held > 1)], held[(stack == side) & (held > 1)]
        block = min(side, 512)
        each = max(1, CELLS // (block * block))
        for at in range(0, len(starts), each):
            some, many = starts[at : at + each], counts[at : at + each]
            for i in range(0, int(many.max()), block):
                for j in range(i, int(many.max()), block):
                    one, two = (some[:, None] + k + np.arange(block) for k in (i, j))
                    size = [np.where(rows < (some + many)[:, None], sizes[np.minimum(rows, len(words) - 1)], -1) for rows in (one, two)]
                    width = max(1, int(max(s.max() for s in size)))
                    cut = [matrix[np.minimum(rows, len(words) - 1)][:, :, :width] * (s > 0)[:, :, None].astype(matrix.dtype) for rows, s in zip((one, two), size)]
                    near, prefix = near_in_block(cut[0], size[0], cut[1], size[1])
                    near &= prefix < bars[some][:, None, None]
                    g, x, y = np.nonzero(near)
                    x, y = one[g, x], two[g, y]
                    found.append((x[x < y], y[x < y]))
    return tuple(np.concatenate(k) for k in zip(*found))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks: near pairs, both ways, of rows that come sorted by group; a group may span batches."""

    def near(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(c).combine_chunks() for c in GROUP]
        fresh = np.zeros(table.num_rows, bool)
        fresh[:1] = True
        for k in keys:
            fresh[1:] |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
        words = table.column("word").combine_chunks()
        # of one length sum: the longer word of a pair must have length m
        i, j = _pairs(words.to_pylist(), np.cumsum(fresh), keys[3].to_numpy())
        m = keys[0].to_numpy()
        sizes = pc.utf8_length(words).to_numpy()
        own = np.maximum(sizes[i], sizes[j]) == m[i]
        i, j = i[own], j[own]
        one, two = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
        return pa.RecordBatch.from_arrays([words.take(one), words.take(two)], ["word", "near"])

    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        table = pa.Table.from_batches(kept)
        last = [table.column(c)[-1].as_py() for c in GROUP]
        start = batch.num_rows
        columns = [batch.column(c) for c in GROUP]
        while start and all(c[start - 1].as_py() == v for c, v in zip(columns, last)):
            start -= 1
        if not start:
            continue  # the group goes on
        whole = table.num_rows - batch.num_rows + start
        yield near(table.slice(0, whole).combine_chunks())
        kept = table.slice(whole).combine_chunks().to_batches()
    if kept:
        yield near(pa.Table.from_batches(kept).combine_chunks())


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, near) both ways, each pair once, of the distinct non-null values of column ``word`` that are one edit apart."""
    groups = _groups(words.select("word").where("word is not null"), crowd)
    sorted_rows = groups.repartition(*GROUP).sortWithinPartitions(*GROUP)
    return sorted_rows.mapInArrow(_compared, "word string, near string")


def spelling_groups(
    counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, crowd: int = CROWD
) -> DataFrame:
    """Per word of ``counts`` (word, n): word, n, n_near, form, form_n, root.

    Words of ``least_length`` code points and ``least_count`` occurrences take part. A word's form is
    the near word of largest n, of equal ones the smallest in code-point order, if that n is
    at least ``factor`` times its own. ``root`` follows forms to the last one; along the way n grows
    by the factor each time, so ``log(n)`` steps reach it.

    Counts of a word that comes in several rows are summed; null words and counts take no part.
    An empty table gives none. Other columns are ignored.
    """
    if factor < 2:
        raise ValueError("a factor below 2 lets forms go round in circles")
    counts = counts.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "spelling-words")
    near = near_words(words, crowd).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= F.col("n") * factor
    found = stored(
        found.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    longest, steps, most = 1, 0, words.agg(F.max("n")).first()[0] or 1
    while least_count * factor**longest <= most:
        longest += 1
    while 2**steps < longest:  # each round doubles the steps taken
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        steps += 1
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))
