"""Writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and no row numbers, one part per partition."""
    df.write.mode(mode).option("header", True).csv(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a finished write left its success marker at ``path``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    refresh: bool = False,
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """Read the table at ``path``, building it first when absent, unfinished or stale."""
    if refresh or not is_complete(spark, path):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)
