"""Readers. Paths may be on any file system Spark can reach."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options
) -> DataFrame:
    """CSV with a header row.

    A fixed schema avoids an extra pass over the file; without one the types are inferred.
    The columns are matched by position, so the schema lists every column of the file.
    A leading byte-order mark is ignored.
    """
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_headerless_csv(
    spark: SparkSession, path: str, columns: Mapping[int, str], **options
) -> DataFrame:
    """CSV without a header: keep the columns at these positions, under these names."""
    raw = spark.read.option("header", False).options(**options).csv(path)
    return raw.select(*[F.col(f"_c{position}").alias(name) for position, name in columns.items()])


def read_text_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A landed sheet whose header is not the first row: all columns stay strings.

    Rows may have any number of cells, so the width comes from the widest line and not from
    the first; cells a row lacks are null.
    """
    mark = options.get("sep", ",")
    cells = F.size(F.split("value", rf"\Q{mark}\E", -1))
    width = spark.read.text(path).agg(F.max(cells)).first()[0] or 1
    schema = ", ".join(f"_c{i} string" for i in range(width))
    return spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE").options(**options).csv(path)


def read_sheets(
    spark: SparkSession, folder: str, schemas: Mapping[str, str | T.StructType]
) -> dict[str, DataFrame]:
    """Several landed sheets, one CSV per sheet, as a dict of tables."""
    return {name: read_csv(spark, f"{folder}/{name}.csv", schema) for name, schema in schemas.items()}


def promote_header(
    df: DataFrame,
    is_header: Column,
    key_pattern: str | None = None,
    rename: Callable[[str], str] = str,
) -> DataFrame:
    """Use the row matching ``is_header`` as column names and keep only data rows.

    Rows have no position in Spark, so preamble and footnotes are recognised by the key in
    the first column: it must match ``key_pattern``. Exactly one small row, the header,
    reaches the driver.
    """
    header = df.filter(is_header).first()
    if header is None:
        raise ValueError("no row matches the header condition")
    keep = [i for i, name in enumerate(header) if name is not None]
    named = df.select(*[F.col(df.columns[i]).alias(rename(header[i])) for i in keep])
    first = F.col(f"`{named.columns[0]}`")
    rows = first.isNotNull() & (first != F.lit(rename(header[keep[0]])))
    if key_pattern is not None:
        rows = first.rlike(key_pattern)
    return named.filter(rows)


def cast_columns(df: DataFrame, types: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Cast columns by name; ``strict=False`` turns unreadable values to null."""

    def converted(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        return column.cast(kind) if strict else column.try_cast(kind)

    return df.withColumns({name: converted(name, kind) for name, kind in types.items()})
