"""Continuous upkeep of a table of texts: a file stream whose batches are upserted into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import SnapshotTable


def latest(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the last row by ``order``; of equals any one."""
    name = _free("_rank", batch)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return batch.withColumn(name, rank).filter(F.col(name) == 1).drop(name)


def _free(name: str, df: DataFrame) -> str:
    """The name, or a longer one that the table does not have."""
    while name in df.columns:
        name += "_"
    return name


def newer(rows: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows that are not older than the stored row of their key."""
    own = [_free(f"_stored_{k}", rows) for k in keys]
    at = _free("_stored_order", rows)
    there = stored.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(order).alias(at))
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    return rows.join(there, same, "left").filter(F.col(at).isNull() | (F.col(order) >= F.col(at))).select(*rows.columns)


def upsert_stream(stream: DataFrame, table: SnapshotTable, keys: list[str], order: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Upsert every micro-batch, the last row of each key; a row that is older than the stored one of its key changes nothing.

    With ``every`` (such as ``10 minutes``) the stream goes on; without it, it handles what is there and ends.  A batch that is run again
    after a failure writes the same rows for the same keys.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            rows = latest(batch, keys, order)
            table.upsert(newer(rows, table.near(rows, keys), keys, order), keys)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def events_by_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and type, for a stream or a table; a stream drops what is later than ``late``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
