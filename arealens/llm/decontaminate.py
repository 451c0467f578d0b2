"""Benchmark decontamination: a broadcast set of test n-grams, scanned over every token window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Most distinct benchmark windows whose hashes are shipped with the plan as they are.
BROADCAST_WINDOWS = 50_000
#: Most bits of the map that is shipped for more windows than that (16 MB), and bits a window gets.
MAP_BITS, BITS_EACH = 1 << 27, 32
#: Bits of one map of Spark's bitmap aggregate.
BUCKET_BITS = 1 << 15


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _starts(tokens: Column, length: int) -> Column:
    """1-based starts of the windows of ``length`` words."""
    n = F.size(tokens)
    empty = F.array().cast("array<int>")
    return F.when(n >= length, F.sequence(F.lit(1), n - (length - 1))).otherwise(empty)


def _window(at: Column, length: int) -> Column:
    return F.slice("_words", at, F.lit(length))


def _pair(hashes: Column, at: Column, size: int | Column) -> Column:
    """Joint hash of the first two words of a window (of one word, that word twice)."""
    second = at + F.least(F.lit(size), F.lit(2)) - 1
    return F.shiftleft(F.get(hashes, at - 1), 1).bitwiseXOR(F.get(hashes, second - 1))


def _hashes(tokens: str) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def benchmark_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, gram, size, hash): every window of an item, or the whole of a short one."""
    tokens = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("_words")).where(F.size("_words") > 0)
    size = F.least(F.size("_words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("_words") - size + 1)
    grams = F.transform(starts, lambda i: F.slice("_words", i, size))
    rows = tokens.select("item", size.alias("size"), F.explode(grams).alias("_gram"))
    return rows.select("item", "size", F.array_join("_gram", " ").alias("gram"), F.xxhash64("_gram").alias("hash"), _pair(_hashes("_gram"), F.lit(1), F.col("size")).alias("head")).distinct()


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted), spans of hit words.

    Windows of ``window`` consecutive item words (a shorter item is one window) are hashed. The
    hash of every token window of a document is looked up in their set (that of its first two
    words before that of the whole, which costs less), the words of windows
    that hit are compared with the benchmark's own, and the words inside any occurrence are
    counted once. ``spans`` are the merged runs of hit words (start, end), 0-based, end exclusive.

    Up to ``broadcast_windows`` distinct hashes, counted first, travel with the plan as a
    hash set. Of a larger benchmark a map of bits does, two for each hash, of at most MAP_BITS;
    a window passes where both its bits are set. Either way documents are read in one pass,
    only windows that pass leave it with their words, and the comparison of words decides, so
    that the rows are the same. (At a million windows about one in 300 others passes the map,
    at ten million about one in 50, at a hundred million three in five.)

    Null and empty texts have no words. Rows that repeat an id and text are one document; an id
    with several texts has a row for each. Repeated items count once per item id; a null item
    id counts as an item without a name. Empty tables give no rows, or no hits. Other columns
    are ignored.
    """
    found = _judged(docs, items, window, broadcast_windows, id_col, text_col, item_col, item_text_col)
    return found.select(F.col("_id").alias(id_col), "n_words", "n_hit", "n_items", "items", "spans")


def _judged(
    docs: DataFrame, items: DataFrame, window: int, broadcast_windows: int, id_col: str, text_col: str, item_col: str, item_text_col: str
) -> DataFrame:
    """``find_contamination`` with the hash of each text: _id, _mark and its columns."""
    grams = stored(benchmark_windows(items, window, item_col, item_text_col), "benchmark-windows")
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # at most ``window`` of them
    hashes = grams.select("hash").distinct()
    few = [r[0] for r in hashes.limit(broadcast_windows + 1).collect()]
    listed = len(few) <= broadcast_windows
    heads: dict[int, list[int]] = {n: [] for n in sizes}
    bits, slots = (None, 0) if listed else _bit_map(hashes)
    if listed:
        for n, head in grams.select("size", "head").distinct().collect():
            heads[n].append(head)

    base = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_mark"), words(F.col(text_col)).alias("_words")
    )
    base = base.withColumn("_wh", _hashes("_words"))

    def hits(n: int) -> Column:
        at = _starts(F.col("_words"), n)
        if listed:
            at = F.filter(at, lambda i: _pair(F.col("_wh"), i, n).isin(heads[n]) & F.xxhash64(_window(i, n)).isin(few))
        else:
            marked = F.transform(at, lambda i: F.struct(i.alias("i"), F.xxhash64(_window(i, n)).alias("h")))
            set_twice = lambda x: _is_set(bits, _slots(x["h"], slots)[0]) & _is_set(bits, _slots(x["h"], slots)[1])
            at = F.transform(F.filter(marked, set_twice), lambda x: x["i"])
        return F.transform(at, lambda i: _hit(i, n))

    found = F.flatten(F.array(*map(hits, sizes))) if sizes else F.lit(None).cast("array<struct<at:int,size:int,gram:string>>")
    rows = base.select("_id", "_mark", F.size("_words").alias("_n"), F.explode_outer(found).alias("_hit"))
    rows = rows.select("_id", "_mark", "_n", "_hit.at", "_hit.size", "_hit.gram")
    known = rows.join(grams.select("gram", "size", "item", F.lit(True).alias("_known")), ["gram", "size"], "left")
    at = F.when(F.col("_known"), F.struct("at", "size"))
    item = F.when(F.col("_known"), F.coalesce(F.col("item").cast("string"), F.lit("")))
    per_doc = known.groupBy("_id", "_mark").agg(
        F.max("_n").alias("_n"), F.collect_set(at).alias("_at"), F.array_sort(F.collect_set(item)).alias("items")
    )
    return per_doc.select(
        "_id",
        "_mark",
        F.col("_n").cast("long").alias("n_words"),
        _merged(F.array_sort("_at")).alias("spans"),
        "items",
    ).select(
        "_id",
        "_mark",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
    )


def _slots(value: Column, slots: int) -> tuple[Column, Column]:
    """The two bits of a hash in a map of ``slots`` bits, a power of two: its low and its high digits."""
    return value.bitwiseAND(slots - 1), F.shiftrightunsigned(value, 64 - (slots.bit_length() - 1))


def _bit_map(hashes: DataFrame) -> tuple[Column, int]:
    """(bytes, bits) of the map of these hashes; what the driver gets is bounded by MAP_BITS."""
    slots = BUCKET_BITS
    wanted = min(MAP_BITS, hashes.count() * BITS_EACH)
    while slots < wanted:
        slots *= 2
    places = hashes.select(F.explode(F.array(*_slots(F.col("hash"), slots))).alias("slot"))
    maps = places.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits")
    )
    whole = bytearray(slots // 8)
    for bucket, part in maps.collect():
        start = (bucket - 1) * BUCKET_BITS // 8
        whole[start : start + len(part)] = part
    return F.lit(bytes(whole)), slots


def _is_set(bits: Column, slot: Column) -> Column:
    byte = F.substr(bits, (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1))
    number = F.ascii(F.decode(byte, "ISO-8859-1"))
    return F.bit_get(number, slot.bitwiseAND(7).cast("int")) == 1


def _hit(at: Column, size: int) -> Column:
    return F.struct(
        at.alias("at"), F.lit(size).alias("size"), F.array_join(_window(at, size), " ").alias("gram")
    )


def _merged(hits: Column) -> Column:
    """Sorted hits (1-based start, size) merged to runs (0-based start, end)."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(runs: Column, hit: Column) -> Column:
        start, end = hit["at"] - 1, hit["at"] - 1 + hit["size"]
        last = F.element_at(runs, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"))
        return F.when(
            (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["end"] >= start),
            F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(grown)),
        ).otherwise(F.concat(runs, F.array(F.struct(start.alias("start"), end.alias("end")))))

    return F.aggregate(hits, empty, add)


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    max_share: float = 0.0,
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The documents whose share of hit words is at most ``max_share``, with all their columns.

    Rows go by id and text, so one is never lost because another has its id; a null id is
    an id like others.
    """
    found = _judged(docs, items, window, broadcast_windows, id_col, text_col, item_col, item_text_col)
    bad = found.where((F.col("n_hit") > 0) & (F.col("n_hit") > max_share * F.col("n_words")))
    bad = bad.select(F.col("_id").alias("_gone"), F.col("_mark").alias("_gone_mark")).distinct()
    same = docs[id_col].eqNullSafe(bad["_gone"]) & (F.xxhash64(docs[text_col]) == bad["_gone_mark"])
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text): every document with its hit words cut out, the rest joined as it stood.

    Characters between two words that stay are kept; those beside a removed run go with it.
    """
    found = find_contamination(docs, items, id_col=id_col, text_col=text_col, **options).where("n_hit > 0")
    marks = found.groupBy(F.col(id_col).alias("_id"), F.col("n_words").alias("_n")).agg(F.max("spans").alias("_spans"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_w", F.regexp_extract_all("_text", F.lit(ANY_CASE), F.lit(0)))
    rows = rows.withColumn("_n", F.coalesce(F.size("_w"), F.lit(0))).join(marks, ["_id", "_n"], "left")
    gaps = F.split("_text", ANY_CASE, -1)
    stays = F.transform(
        "_w",
        lambda w, i: F.when(
            F.exists("_spans", lambda s: (i >= s["start"]) & (i < s["end"])), F.lit("")
        ).otherwise(F.concat(w, F.get(gaps, i + 1))),
    )
    cleaned = F.concat(F.get(gaps, F.lit(0)), F.array_join(stays, ""))
    return rows.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(cleaned).alias(text_col),
    )
