"""Exact duplicates by progressive refinement: length, then a hash of the head, then the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Characters the second level hashes.
HEAD = 256


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept (and text_sha256).

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id stays.
    Rows are grouped by length; groups of several by a hash of their head; only documents that
    still share a group are grouped by the SHA-256 of their whole text. The levels move narrow rows,
    counted before they are shuffled, so a group with a third of all rows costs no more than
    others.

    ``digest_all`` adds ``text_sha256``, the digest of every normalised text; it is then made when the
    texts are first read, and texts do not move at all. Without it only documents that share a group are
    hashed, in a second reading that moves texts keyed by document.

    A null text counts as empty. A null id is smaller than any other. Rows that repeat an id
    and text count separately in group_size and are marked alike; several texts under one id are
    judged each by itself. An empty table gives none. Other columns are ignored.
    """
    found = _judged(docs, id_col, text_col, digest_all)
    own = ["text_sha256"] if digest_all else []
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), *own)


def _judged(docs: DataFrame, id_col: str, text_col: str, digest_all: bool) -> DataFrame:
    """(_id, keep_id, group_size, text_sha256); the digest is null where it was not needed."""
    digest = F.sha2(ascii_lower(F.col("_text")).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shape = [
        F.coalesce(F.octet_length("_text"), F.lit(0)).alias("_bytes"),
        F.xxhash64(ascii_lower(F.substring("_text", 1, HEAD))).alias("_head"),
    ]
    own = digest if digest_all else F.lit(None).cast("string")
    base = stored(rows.select("_id", *shape, own.alias("_digest")), "exact-base")
    same_length = base.join(_repeated(base, "_bytes"), "_bytes", "left_semi")
    same_head = stored(_repeated(same_length, "_bytes", "_head"), "exact-heads")
    hashed = base.join(same_head, ["_bytes", "_head"], "left_semi")
    if not digest_all:
        key = F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("_key")
        wanted = hashed.select(key).distinct()
        read = rows.select("*", key).join(wanted, "_key", "left_semi").select("_id", *shape, digest.alias("_digest"))
        hashed = stored(read, "exact-hashed").join(same_head, ["_bytes", "_head"], "left_semi")
    groups = hashed.groupBy("_digest").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    shared = hashed.join(groups, "_digest").select("_id", "keep_id", "group_size", F.col("_digest").alias("text_sha256"))
    alone = base.join(same_head, ["_bytes", "_head"], "left_anti")
    alone = alone.select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.col("_digest").alias("text_sha256"))
    return shared.unionByName(alone)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row of each text.

    Rows go by id and digest, so a text is never lost because another has its id. Of rows with
    the same id and text one stays; rows without an id stay.
    """
    found = _judged(docs, id_col, text_col, False).where("group_size > 1 and _id is not null")
    found = stored(found.groupBy("_id", F.col("text_sha256").alias("_digest")).agg(F.max("keep_id").alias("_keep"), F.count(F.lit(1)).alias("_n")), "exact-shared")
    gone = found.where(F.col("_id") != F.col("_keep")).select("_id", "_digest")
    again = found.where((F.col("_id") == F.col("_keep")) & (F.col("_n") > 1)).select("_id", "_digest")
    digest = F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)
    rows = docs.withColumns({"_id": F.col(id_col), "_digest": digest}).join(gone, ["_id", "_digest"], "left_anti")
    if again.head(1):
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        first = rows.join(again, ["_id", "_digest"], "left_semi").groupBy("_id", "_digest").agg(F.first(whole).alias("_row"))
        rows = rows.join(again, ["_id", "_digest"], "left_anti").select(*docs.columns).unionByName(first.select("_row.*"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
