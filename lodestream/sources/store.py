"""Versioned tables on any file system that Spark reaches.

Plain Parquet has no MERGE, and files must not be overwritten while they are read.  A table is therefore a manifest that names folders of rows.  Rows
are dealt into buckets by a hash of the table's keys; a change reads and writes the buckets that it touches and takes over the others as they
are.  A new version counts from the moment its manifest is renamed into place; readers keep the version they began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders that a bucket may consist of before an append merges them.
MOST_PARTS = 16
_BUCKET = "_bucket"


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keep: int = 3, keys: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.keep, self.keys, self.buckets = spark, path.rstrip("/"), keep, keys, buckets if keys else 1
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        #: Where tables change together: gives the version that counts, None for the newest.
        self.pin: Callable[[], int | None] | None = None

    # --- files

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def versions(self) -> list[int]:
        """Complete versions, ascending."""
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())

    @property
    def version(self) -> int:
        """The current version, 0 before the first."""
        return (self.versions() or [0])[-1]

    @property
    def current(self) -> int:
        """The version that readers see and changes start from."""
        pinned = self.pin() if self.pin else None
        return self.version if pinned is None else pinned

    def _manifest(self, version: int) -> dict[int, list[str]]:
        """Of each bucket that has rows, its folders."""
        if not version:
            return {}
        fs, where = self._fs(f"{self.path}/manifest-{version}.json")
        stream = fs.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): folders for b, folders in json.loads(text).items()}

    def _commit(self, manifest: dict[int, list[str]], after: int) -> int:
        number = after + 1
        fs, final = self._fs(f"{self.path}/manifest-{number}.json")
        _, draft = self._fs(f"{self.path}/_draft-{uuid.uuid4().hex}")
        stream = fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer made version {number} of {self.path}")
        self._clean(number)
        return number

    def _clean(self, newest: int) -> None:
        """Drop versions before the last ``keep``, and folders that only they name."""
        seen = self.current
        old = [v for v in self.versions() if v <= newest - self.keep and v != seen]
        if not old:
            return
        used = {f.split("/")[0] for v in self.versions() if v not in old for folders in self._manifest(v).values() for f in folders}
        gone = {f.split("/")[0] for v in old for folders in self._manifest(v).values() for f in folders} - used
        for name in [*sorted(gone), *(f"manifest-{v}.json" for v in old)]:
            fs, where = self._fs(f"{self.path}/{name}")
            fs.delete(where, True)

    # --- rows

    def _typed(self, rows: DataFrame) -> DataFrame:
        have = {c.lower() for c in rows.columns}
        return rows.select(*[(F.col(f"`{f.name}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])

    def bucket_of(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def _read(self, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self._manifest(self.current if version is None else version)
        return self._read(f for folders in manifest.values() for f in folders)

    def _store(self, rows: DataFrame) -> dict[int, list[str]]:
        """Write rows by bucket into a new folder; returns the buckets that came of it.

        Rows are brought together by bucket first, small buckets in one task and large ones in several, so files do not multiply.
        """
        name = f"rows-{uuid.uuid4().hex}"
        self._typed(rows).withColumn(_BUCKET, self.bucket_of(*(self.keys or []))).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{name}")
        fs, where = self._fs(f"{self.path}/{name}")
        found = [s.getPath().getName() for s in fs.listStatus(where)]
        return {int(f.split("=")[1]): [f"{name}/{f}"] for f in found if f.startswith(f"{_BUCKET}=")}

    def write(self, df: DataFrame) -> int:
        """Make ``df`` the content of the table; returns the version's number."""
        return self._commit(self._store(df), self.version)

    def replace(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Change the whole table by a function of its rows."""
        return self.write(change(self.read()))

    def append(self, rows: DataFrame) -> int:
        """Add rows without touching those that are there."""
        version = self.version
        manifest, added = self._manifest(self.current), self._store(rows)
        joint = {b: manifest.get(b, []) + added.get(b, []) for b in manifest.keys() | added.keys()}
        long = [b for b, folders in joint.items() if len(folders) > MOST_PARTS]
        if long:
            joint |= self._store(self._read(f for b in long for f in joint[b]))
        return self._commit(joint, version)

    def merge(self, gone: DataFrame | None, fresh: DataFrame | None) -> int:
        """Drop the rows whose key columns match a row of ``gone`` (on all its columns), then add ``fresh``.

        Where ``gone`` has the table's keys, only the buckets of its rows and of ``fresh`` are read and written; their numbers are all that comes
        to the driver.
        """
        version = self.version
        manifest = self._manifest(self.current)
        columns = gone.columns if gone is not None else (self.keys or [])
        touched = set(range(self.buckets))
        if self.keys and columns == self.keys:
            touched = self._touched([df for df in (gone, fresh) if df is not None])
        rows = self._read(f for b, folders in manifest.items() if b in touched for f in folders)
        if gone is not None:
            rows = rows.join(gone.distinct(), columns, "left_anti")
        stored = self._store(self._typed(rows) if fresh is None else self._typed(rows).unionByName(self._typed(fresh)))
        return self._commit({b: f for b, f in manifest.items() if b not in touched} | stored, version)

    def _touched(self, parts: list[DataFrame]) -> set[int]:
        return {r["b"] for df in parts for r in df.select(self.bucket_of(*self.keys).alias("b")).distinct().collect()}

    def near(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """The rows that can share a key with one of ``rows``: those of the same buckets where the table is dealt by these keys."""
        if self.keys != keys:
            return self.read()
        touched = self._touched([rows])
        return self._read(f for b, folders in self._manifest(self.current).items() if b in touched for f in folders)

    def upsert(self, rows: DataFrame, keys: list[str]) -> int:
        """Rows with a key of the table replace its rows, the others are added."""
        return self.merge(rows.select(*keys), rows)

    def delete(self, keys: DataFrame) -> int:
        """Drop the rows that match a row of ``keys`` on all its columns."""
        return self.merge(keys, None)

    def seed(self, rows: DataFrame, keys: list[str]) -> int:
        """Add rows whose key the table does not have; existing rows win."""
        return self.append(rows.join(self.read().select(*keys), keys, "left_anti"))

    def truncate(self) -> int:
        return self._commit({}, self.version)

    def drop(self) -> None:
        fs, where = self._fs(self.path)
        fs.delete(where, True)
