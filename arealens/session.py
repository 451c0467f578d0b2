"""Session helpers: a local session for tests and benches, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", app: str = "arealens") -> SparkSession:
    """Session for tests and benches on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the session.

    A machine-local folder is only taken when nothing is set and Spark itself runs in
    one process.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] == "local":  # local-cluster has several processes
        folder = tempfile.mkdtemp(prefix="arealens-")
        spark.conf.set(CHECKPOINT_CONF, folder)
        return folder
    raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/arealens/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so lost executors never replay its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
