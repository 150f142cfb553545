"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped_at_exit, scratch_path, small_batches

#: White space of the word contracts: space and the control characters 9 to 13.  ``bytes.split()`` splits on exactly these.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"

#: Bytes of text that a Python step holds at once, whatever the Arrow batch size is.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; one in fewer pieces than there are cores is dealt out, since the work on a row outweighs moving it."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found if found.rdd.getNumPartitions() >= cores else found.repartition(cores)


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Like :func:`lodestream.session.written`, in as many buckets by ``keys`` as a shuffle has partitions: joins on them read it where it lies.

    Rows that a shuffle on ``keys`` has dealt out give one file a bucket.  The catalog entry is dropped at once; what is returned keeps the files.
    """
    spark = df.sparkSession
    path, table_name = scratch_path(spark, name), f"lodestream_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark):
        df.write.format("parquet").bucketBy(buckets, *keys).option("compression", "zstd").option("path", path).saveAsTable(table_name)
    dropped_at_exit(spark, path)
    found = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")
    return found


def text_or_empty(column: str) -> Column:
    """The text, with null read as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds at most ``limit`` bytes (always one row at least)."""
    array = batch.column(column)
    sizes = pc.binary_length(array).fill_null(0).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def places(values: list, wanted) -> Iterator[int]:
    """Indexes at which ``wanted`` stands."""
    at = -1
    try:
        while True:
            yield (at := values.index(wanted, at + 1))
    except ValueError:
        return


def byte_values(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def text_values(array: pa.Array) -> list[str]:
    """Text of every value, null as empty."""
    return [x or "" for x in array.to_pylist()]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of the class ``characters`` (as inside square brackets) a text has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("bigint")
