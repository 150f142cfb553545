"""Named collections of vectors with a payload: upsert, filtered search, point reads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.config import is_valid_name
from ..sources.store import SnapshotTable
from .search import top_k

ROW = "id string, document_id string, sequence_number int, text string, extra string, embedding array<float>"


class Collection:
    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.name = spark, name
        self.table = SnapshotTable(spark, f"{path}/{name}/rows", ROW, keys=["id"], buckets=16)
        self.meta = SnapshotTable(spark, f"{path}/{name}/meta", "dimension int")

    @property
    def dimension(self) -> int:
        return self.meta.read().first()["dimension"]

    def upsert(self, rows: DataFrame) -> int:
        """Rows with the columns of ``ROW``; those with a known id replace it.  A vector of another dimension raises."""
        n = self.dimension
        checked = F.when(F.size("embedding") == n, F.col("embedding")).otherwise(F.raise_error(f"vectors of {self.name} have {n} numbers").cast("array<float>"))
        return self.table.upsert(rows.withColumn("embedding", checked), ["id"])

    def put(self, items: Iterable[dict[str, Any]]) -> list[str]:
        """Few rows from the driver: ``id`` (drawn if left out), ``document_id``, ``sequence_number``, ``text``, ``embedding``; other members
        are kept as extras, by which searches can filter."""
        known = ("id", "document_id", "sequence_number", "text", "embedding")
        rows = []
        for item in items:
            extra = json.dumps({k: v for k, v in item.items() if k not in known})
            rows.append((str(item.get("id") or uuid.uuid4()), item.get("document_id"), item.get("sequence_number"), item.get("text"), extra, [float(x) for x in item["embedding"]]))
        self.upsert(self.spark.createDataFrame(rows, ROW))
        return [r[0] for r in rows]

    def _matching(self, where: dict[str, Any] | None) -> DataFrame:
        found = self.table.read()
        for name, value in (where or {}).items():
            own: Column = F.col(name) if name in ("id", "document_id", "sequence_number") else F.get_json_object("extra", f"$['{name}']")
            found = found.filter(own.cast("string") == F.lit(str(value)))
        return found

    def search(self, query: Sequence[float], limit: int = 10, where: dict[str, Any] | None = None) -> DataFrame:
        """The nearest rows with their cosine in ``score``."""
        best = top_k(self._matching(where), query, limit, id_col="id")
        return best.select("id", "document_id", "sequence_number", "text", "extra", F.col("sim").alias("score"))

    def get(self, key: str) -> dict | None:
        row = self.table.read().filter(F.col("id") == key).first()
        return None if row is None else row.asDict()

    def delete(self, key: str) -> None:
        self.table.delete(self.spark.createDataFrame([(key,)], "id string"))


class VectorStore:
    """Collections under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self, name: str, dimension: int) -> Collection:
        if not is_valid_name(name):
            raise ValueError(f"collection name {name!r} does not match [a-z][a-z0-9_]*")
        if name in self.names():
            raise ValueError(f"collection {name} exists")
        made = Collection(self.spark, self.path, name)
        made.meta.write(self.spark.createDataFrame([(dimension,)], "dimension int"))
        made.table.truncate()
        return made

    def open(self, name: str) -> Collection:
        if name not in self.names():
            raise KeyError(f"no collection {name}")
        return Collection(self.spark, self.path, name)

    def names(self) -> list[str]:
        fs, root = SnapshotTable(self.spark, self.path, "x int")._fs(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    def drop(self, name: str) -> None:
        fs, where = SnapshotTable(self.spark, self.path, "x int")._fs(f"{self.path}/{name}")
        fs.delete(where, True)
