"""Spark session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch while scratch tables are written.
BATCH_ROWS = 1000


def get_spark(app: str = "lodestream", cores: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested under; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores or '*'}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor and the driver can reach.

    ``spark.checkpoint.dir`` of the session wins.  Where it is unset a plain local session gets a temporary folder; any other master falls
    back to the warehouse, unless that is on a local disk, which is an error.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = context.master
    if master == "local" or master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestream-"))
        return context.getCheckpointDir().rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith("file:") or "://" not in warehouse:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: the warehouse is a folder of one machine")
    return warehouse + "/_lodestream"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it back.

    Unlike a cache this survives the loss of executors, and later stages see file sizes and statistics.  ``level`` is that of the compression.
    """
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    dropped_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver remove an existing scratch path when it ends in good order."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, at most ``rows`` rows go to Python at once: rows may be long texts, and a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
