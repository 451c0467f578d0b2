"""Content-addressed web archive: payloads stored once by digest, exact headers beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hexadecimal digest whose length is a multiple of 5 digits."""

    def four(i: Column) -> Column:
        bits = F.conv(F.substr(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        letters = [
            F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)
        ]
        return F.concat(*letters)

    return F.array_join(F.transform(F.sequence(F.lit(0), (F.length(digest) / 5 - 1).cast("int")), four), "")


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing when the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _uri(page: Column) -> Column:
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    captured: str = "1970-01-01T00:00:00Z",
    min_bytes: int = 0,
) -> None:
    """Write ``pages`` below ``path`` (a folder all executors share).

    ``payloads`` holds every distinct payload once, keyed by its SHA-256 digest; ``headers`` holds
    the exact header of every record and the key of its payload. Of the records with an equal
    payload of at least ``min_bytes`` bytes the one with the largest id is a ``response`` and
    the others are ``revisit`` records that refer to it; smaller payloads are all responses.
    Copies of a payload are merged before they are shuffled. Equal digests with unequal
    lengths would be a collision and stop the job.

    Payloads are UTF-8 bytes; a null payload is empty. A null url has no target line, line ends
    in a url are percent-encoded. A null id is smaller than any other. Rows that repeat an id
    each get a record; several of them may be the response of one payload. An empty table
    gives an empty archive. Other columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))

    one_size = F.when(F.min("size") != F.max("size"), F.raise_error(F.lit("digest collision"))).otherwise(F.min("size"))
    store = rows.groupBy("key").agg(F.first("payload").alias("payload"), one_size.alias("size"))
    store.write.parquet(f"{path}/payloads")

    facts = rows.withColumn("sha1", F.sha1("payload")).drop("payload")
    winners = facts.groupBy("key").agg(F.max("page").alias("winner"))
    marked = facts.join(winners, "key").withColumn(
        "revisit", (F.col("size") >= min_bytes) & ~F.col("page").eqNullSafe(F.col("winner"))
    )
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _uri(F.col("page"))),
        _line("WARC-Date", F.lit(captured)),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _uri(F.col("winner")))),
        _line("WARC-Profile", F.when(F.col("revisit"), F.lit(PROFILE))),
        _line("Content-Type", F.when(~F.col("revisit"), F.lit("text/html; charset=utf-8"))),
        _line("Content-Length", F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    marked.select(header.cast("binary").alias("header"), "key").write.parquet(f"{path}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The fields of every record: page_id, type, url, stated digest, refers_to, key, header."""
    number = lambda name: F.regexp_extract(_field(name), rf"^<{ID_PREFIX}(-?[0-9]+)>$", 1)
    headers = spark.read.schema("header binary, key string").parquet(f"{path}/headers")
    return headers.select(
        number("WARC-Record-ID").try_cast("long").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        F.nullif(_field("WARC-Target-URI"), F.lit("")).alias("url"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("stated_digest"),
        number("WARC-Refers-To").try_cast("long").alias("refers_to"),
        "key",
        "header",
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads; bytes that no longer match their key stop the job."""
    store = spark.read.schema("key string, payload binary, size long").parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload"))
    return store.select(
        "key", F.coalesce(sound, F.raise_error(F.lit("payload does not match its digest"))).alias("payload")
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record as it was: its fields, the full payload, and the exact record bytes.

    Headers are joined to the payloads they name. ``payload_bytes`` and ``payload_digest`` are
    taken from the joined payload; a header that states another digest, or another
    length of its own block, stops the job.
    """
    ends = F.lit("\r\n\r\n").cast("binary")
    own = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    records = read_headers(spark, path).join(read_payloads(spark, path), "key")
    records = records.withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("long"),
            "payload_digest": base32_of_hex(F.sha1("payload")),
            "record": F.concat("header", own, ends),
        }
    )
    block = F.octet_length("record") - F.octet_length("header") - 4
    sound = (F.col("payload_digest") == F.col("stated_digest")) & (block == _field("Content-Length").try_cast("long"))
    wrong = F.raise_error(F.lit("record does not match its header")).cast("string")
    return records.withColumn("payload_digest", F.when(sound, F.col("payload_digest")).otherwise(wrong))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, with size and digest taken from the stored payload.

    Each payload is read and hashed once; only its size and digest are joined to the headers.
    """
    facts = read_payloads(spark, path).select(
        "key",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_of_hex(F.sha1("payload")).alias("payload_digest"),
    )
    return read_headers(spark, path).join(facts, "key")
