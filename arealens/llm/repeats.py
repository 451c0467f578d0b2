"""What the two substring operators share: where to look for repeats, and what to cut.

A text is a sequence of units, words or bytes; a window is a run of fixed length. Comparing
every window with every other would ship a row per unit, so candidates are found first, without
loss: of the short grams inside a window the one with the smallest hash names it, and equal
windows have equal names. Windows in a row with one name form a segment. Only segments whose
name occurs elsewhere are shipped, equal ones once; what differs inside a name is compared
by the operator's own method, in tasks that hold a bounded number of segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import stored

#: Bytes of segments compared at once.
BLOCK_BYTES = 1 << 20

#: (segments, [rank of id, rank of document, number of name] of each, start in the document) ->
#: for each segment the windows (from, to) that also occur earlier.
Compare = Callable[[list[bytes], np.ndarray, np.ndarray], list[list[tuple[int, int]]]]


@dataclass(frozen=True)
class Units:
    """How a text is cut: words or bytes, the window length, and the gram that names windows."""

    words: bool
    window: int
    gram: int

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every unit, and the first unit of each text."""
        if not self.words:
            return arrays.LETTERS[data], offsets
        starts, ends, first = arrays.words(data, offsets)
        return arrays.word_hashes(data, starts, ends), first


def _sliding(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """``pick`` (minimum or maximum) of every run of ``width`` values."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def runs(units: Units, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, name) of every segment, and (text, name) keys of repeated grams."""
    span = units.window - units.gram + 1
    none = np.zeros(0, np.int64)
    if len(hashes) < units.window:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = arrays.rolling(hashes, units.gram)
    least = _sliding(grams, span, np.minimum)
    at = np.flatnonzero(owner[: len(least)] == owner[units.window - 1 :])
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    name = least[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(at)))
    # a gram that names windows at two places of one segment
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    naming = np.flatnonzero(_sliding(padded, span, np.maximum)[: len(grams)] == grams)
    twice = (grams[naming[1:]] == grams[naming[:-1]]) & (np.diff(naming) <= span) & (owner[naming[1:]] == owner[naming[:-1]])
    where = naming[:-1][twice]
    return owner[at[begin]], at[begin], count, name[begin], _joint(owner[where], grams[where])


def _joint(owner: np.ndarray, name: np.ndarray) -> np.ndarray:
    return arrays.mix(name + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _names(units: Units):
    """Tasks: (name, who) of every segment, once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in arrays.slices(batches):
            owner, _, _, name, _ = runs(units, *units.cut(data, offsets))
            _, keep = np.unique(_joint(owner, name), return_index=True)
            keep.sort()
            yield pa.RecordBatch.from_arrays([pa.array(name[keep].view(np.int64)), rows.column("who").take(pa.array(owner[keep]))], ["name", "who"])

    return run


def _segments(units: Units, inside: bool):
    """Tasks: the segments of every text whose name occurs elsewhere (or twice in it, if ``inside``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in arrays.slices(batches):
            hashes, first = units.cut(data, offsets)
            owner, at, count, name, again = runs(units, hashes, first)
            joint = _joint(owner, name)
            lists = rows.column("names")
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            listed = lists.flatten().to_numpy().view(np.uint64) if sizes.sum() else np.zeros(0, np.uint64)
            use = np.isin(joint, _joint(np.repeat(np.arange(len(sizes)), sizes), listed))
            twice = np.isin(joint, again)
            if inside:
                _, back, times = np.unique(joint, return_inverse=True, return_counts=True)
                use |= twice | (times[back] > 1)
            pick = np.flatnonzero(use)
            raw, keys, contents, seen = data.tobytes(), [], [], set()
            split_of, split = -1, []
            for i in pick.tolist():
                text, low = int(owner[i]), int(at[i])
                high = low + int(count[i]) - 1 + units.window
                if units.words:
                    if text != split_of:
                        split_of, split = text, raw[offsets[text] : offsets[text + 1]].split()
                    content = b" ".join(split[low - first[text] : high - first[text]])
                else:
                    content = raw[low:high]
                key = hashlib.blake2b(content, digest_size=16).digest()
                keys.append(key)
                contents.append(None if key in seen else content)
                seen.add(key)
            owners = pa.array(owner[pick])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(name[pick].view(np.int64)), pa.array(keys, pa.binary()), rows.column("id").take(owners), rows.column("who").take(owners),
                    pa.array(at[pick] - first[owner[pick]]), pa.array(count[pick]), pa.array(twice[pick]), pa.array(contents, pa.binary()),
                ],
                ["name", "key", "id", "who", "at", "n", "twice", "content"],
            )

    return run


def _compared(compare: Compare):
    """Tasks: (key, from, to) of the windows of every segment that occur earlier; rows come sorted by name."""

    def flags(held: list[tuple]) -> pa.RecordBatch:
        names, keys, contents, ids, whos, ats = map(list, zip(*held))
        order = {d: i for i, d in enumerate(sorted(set(zip(ids, whos))))}
        place = np.array([order[d] for d in zip(ids, whos)])
        by_id = {x: i for i, x in enumerate(sorted(set(ids)))}
        _, group = np.unique(np.array(names), return_inverse=True)
        found = compare(contents, np.stack([np.array([by_id[x] for x in ids]), place, group]), np.array(ats))
        flat = [(k, a, b) for k, ranges in zip(keys, found) for a, b in ranges]
        return pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in flat], pa.binary()), pa.array([f[1] for f in flat], pa.int64()), pa.array([f[2] for f in flat], pa.int64())],
            ["key", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("name", "key", "content", "id", "who", "at"))):
                if row[0] != last and size >= BLOCK_BYTES:
                    yield flags(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[2])
        if held:
            yield flags(held)

    return run


def _windows(units: Units):
    """Tasks: (key, low, window, id, who, at) of every window of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content, id_, who, at, n in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "id", "who", "at", "n"))):
                parts = content.split() if units.words else content
                cut = (lambda i: b" ".join(parts[i : i + units.window])) if units.words else (lambda i: parts[i : i + units.window])
                digests = [hashlib.blake2b(cut(i), digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array(digests, pa.binary()), pa.array([id_] * n, batch.column("id").type), pa.array([who] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())],
                    ["key", "low", "digest", "id", "who", "at"],
                )

    return run


def repeated_windows(texts: DataFrame, units: Units, compare: Compare, inside: bool, crowd: int) -> DataFrame:
    """(who, ranges): per document the windows (low, high) that also start earlier.

    Up to ``crowd`` different segments of one name are compared in one task; names with more are
    compared window by window through grouping instead.

    ``texts`` has id, who (a hash of id and text) and text. Earlier is a smaller id; with
    ``inside`` also the same document further left.
    """
    kind = texts.schema["id"].dataType.simpleString()
    names = texts.select("who", "text").mapInArrow(_names(units), "name long, who long")
    shared = names.groupBy("name").agg(F.min("who").alias("lo"), F.max("who").alias("hi")).where("lo < hi").select("name")
    known = names.join(shared, "name").groupBy("who").agg(F.collect_set("name").alias("names"))
    known = stored(known, "repeat-names")
    schema = f"name long, key binary, id {kind}, who long, at long, n long, twice boolean, content binary"
    rows = texts.join(known, "who", "left").select("id", "who", "text", "names")
    found = stored(rows.mapInArrow(_segments(units, inside), schema), "repeat-segments")

    first = F.min(F.struct("id", "who", "at"))
    distinct = found.groupBy("name", "key").agg(
        first.alias("first"), F.max("n").alias("n"), F.max("twice").alias("twice"), F.count(F.lit(1)).alias("times")
    )
    distinct = stored(distinct.select("name", "key", "n", "twice", "times", "first.id", "first.who", "first.at"), "repeat-distinct")
    crowds = distinct.groupBy("name").agg(F.count(F.lit(1)).alias("v"), F.max("twice").alias("again"))
    crowds = crowds.where((F.col("v") > 1) | F.col("again")).select("name", "v") if inside else crowds.where("v > 1").select("name", "v")
    contents = found.where(F.col("content").isNotNull()).select("name", "key", "content").join(crowds, "name")
    contents = contents.groupBy("key").agg(F.first("content").alias("content"), F.max("v").alias("v"))
    differing = distinct.drop("twice", "times").join(contents, "key")
    differing = stored(differing, "repeat-differing")
    bounded = differing.where(F.col("v") <= crowd).select("name", "key", "content", "id", "who", "at")
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    bounded = bounded.repartition(parts, "name").sortWithinPartitions("name")
    flags = bounded.mapInArrow(_compared(compare), "key binary, low long, high long")

    single = differing.where(F.col("v") > crowd).mapInArrow(_windows(units), f"key binary, low long, digest binary, id {kind}, who long, at long")
    origin = F.min(F.struct("id", "who", "at"))
    earliest = single.groupBy("digest").agg(origin.alias("origin"))
    own = F.struct("id", "who", "at")
    later = (F.col("origin") < own) if inside else (F.col("origin.id") < F.col("id"))
    crowded = single.join(earliest, "digest").where(later).select("key", "low", (F.col("low") + 1).alias("high"))
    flags = stored(flags.unionByName(crowded).groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "repeat-flags")

    origins = distinct.where(F.col("times") > 1).select("key", F.col("id").alias("id0"), F.col("who").alias("who0"), F.col("at").alias("at0"))
    occurrences = found.select("key", "id", "who", "at", "n").join(origins, "key", "left").join(flags, "key", "left")
    if inside:
        copy = (F.col("id0") < F.col("id")) | (F.col("who0") != F.col("who")) | (F.col("at0") != F.col("at"))
    else:
        copy = F.col("id0") < F.col("id")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n").alias("high")))
    ranges = F.when(F.coalesce(copy, F.lit(False)), whole).otherwise(F.col("ranges"))
    cut = occurrences.select("who", "at", F.explode(ranges).alias("r"))
    cut = cut.select("who", F.struct((F.col("at") + F.col("r.low")).alias("low"), (F.col("at") + F.col("r.high")).alias("high")).alias("r"))
    return stored(cut.groupBy("who").agg(F.array_sort(F.collect_set("r")).alias("ranges")), "repeat-ranges")


def _cut(units: Units, texts_out: bool):
    """Tasks: what is left of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in arrays.slices(batches):
            raw, ranges = data.tobytes(), rows.column("ranges").to_pylist()
            sizes, removed, spans, digests, kept_texts = [], [], [], [], []
            for i, own in enumerate(ranges):
                text = raw[offsets[i] : offsets[i + 1]]
                parts = text.split() if units.words else text
                n, merged = len(parts), []
                for r in own or ():
                    low, high = r["low"], r["high"] - 1 + units.window
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                pieces, done = [], 0
                for low, high in merged:
                    pieces.append(parts[done:low])
                    done = high
                pieces.append(parts[done:])
                kept = b" ".join(w for p in pieces for w in p) if units.words else b"".join(pieces)
                sizes.append(n)
                removed.append(sum(b - a for a, b in merged))
                spans.append([{"start": a, "end": b} for a, b in merged])
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept if texts_out else None)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary())],
                ["id", "n", "n_removed", "spans", "kept_sha256", "kept"],
            )

    return run


def without_repeats(
    docs: DataFrame, units: Units, compare: Compare, inside: bool, id_col: str, text_col: str, texts_out: bool, crowd: int
) -> DataFrame:
    """Per row of ``docs``: id, n, n_removed, spans (units removed), kept_sha256, kept (bytes, if asked for)."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("who"), text.alias("text"))
    ranges = repeated_windows(texts.where("id is not null"), units, compare, inside, crowd)
    rows = texts.join(ranges, "who", "left")
    rows = rows.select("id", "text", F.when(F.col("id").isNotNull(), F.col("ranges")).alias("ranges"))
    schema = f"id {kind}, n long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"
    return rows.mapInArrow(_cut(units, texts_out), schema).withColumnRenamed("id", id_col)
