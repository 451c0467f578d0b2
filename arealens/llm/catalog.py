"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arealens.session import scratch_path

from . import decontaminate, exact, jaccard, language, mixing, negatives, pieces, pii, spelling, substrings, suffixes, tokens, warc

#: Target weights of the sources; sources not named weigh 1.
MIX_WEIGHTS = {"src0": 2.0}
MIX_SEED = 7
TOKENIZER, TOKEN_LIMIT = "byte_bpe_50k.json", 512
PIECE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_private(_table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < pii.KINDS.index("term"))
    counts = [
        F.size(F.filter("spans", lambda s: s["kind"] == F.lit(i))).cast("long").alias(f"n_{pii.KINDS[i]}")  # noqa: B023
        for i in range(5)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.span_text(base).cast("binary"), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(_table(spark, folder, "pages"), path)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _digest_columns(found: DataFrame, size: str, *more: Column) -> DataFrame:
    return found.select("doc_id", F.col("n").alias(size), "n_removed", *more, "kept_sha256")


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.drop_repeated_passages(_table(spark, folder, "documents"), texts=False)
    return _digest_columns(found, "n_words")


def op6_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.drop_repeated_bytes(_table(spark, folder, "documents"), texts=False)
    return _digest_columns(found, "n_bytes", F.size("spans").cast("long").alias("n_spans"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(_table(spark, folder, "documents"), digest_all=True)


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"), MIX_WEIGHTS, seed=MIX_SEED)


def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_groups(_table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(TOKENIZER)
    return tokens.count_tokens(_table(spark, folder, "documents"), str(path), TOKEN_LIMIT)


def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = str(public_tokenizers.path(PIECE_MODEL))
    found = pieces.decode_ids(pieces.encode_texts(_table(spark, folder, "documents"), path), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    counts = spelling.word_counts(_table(spark, folder, "documents"), least_length=spelling.LEAST_LENGTH)  # none grows longer
    return spelling.spelling_groups(counts).select("word", "n", "n_near", "form", "form_n", "root")


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, folder, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS2 = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{decontaminate.WORD}')"

ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS2} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS2} AS w FROM benchmark),
        grams AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        windows AS (
            SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
                  FROM d, (SELECT DISTINCT size FROM grams) WHERE len(w) >= size)),
        hits AS (SELECT doc_id, item_id, i, size FROM windows JOIN grams USING (gram, size)),
        covered AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
        named AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op3_warc": f"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
        best AS (SELECT h, max(page_id) AS winner FROM p GROUP BY 1)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('{warc.BASE32}',
                   (((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::BIGINT) >> ((3 - i % 4) * 5)::INT) & 31)::INT + 1, 1)), '')
                   AS payload_digest,
               CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
        FROM p JOIN best USING (h)""",
    "op7_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM n JOIN g USING (t)""",
    "op8_mixing": f"""
        WITH s AS (
            SELECT coalesce(source, '') AS s, sum(coalesce(strlen(text), 0))::DOUBLE AS bytes,
                   CASE WHEN coalesce(source, '') = 'src0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
            FROM documents GROUP BY 1),
        r AS (SELECT s, weight * (sum(bytes) OVER ()) / ((sum(weight) OVER ()) * bytes) AS rate FROM s),
        steps AS (
            SELECT s, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS cdf
            FROM (SELECT s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r WHERE rate > 0)),
        d AS (
            SELECT *, (('0x' || substr(md5('{MIX_SEED}:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
            FROM documents),
        n AS (
            SELECT d.doc_id, count(*)::BIGINT AS n_copies
            FROM d JOIN steps ON steps.s = coalesce(d.source, '') AND steps.cdf < d.u GROUP BY 1),
        c AS (SELECT doc_id, n_copies, unnest(range(0, n_copies)) AS copy FROM n)
        SELECT documents.*, copy, n_copies, md5('{MIX_SEED + 1}:' || doc_id || ':' || copy) AS shuffle_key
        FROM documents JOIN c USING (doc_id)""",
}

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_pii, op2_decontamination, op3_warc, op4_substring_dedup, op5_language, op6_suffix_array, op7_exact_dedup, op8_mixing, op9_ngram_jaccard, op10_token_counts, op11_sentencepiece, op12_spelling, op13_hard_negatives)
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
