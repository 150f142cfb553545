"""The incremental index of a project: scan, compare by content hash, chunk and embed what changed, commit one new snapshot.

The comparison comes before the costly steps, so an unchanged file costs its hash alone.  Ids are hashes of what they identify; they are the
same on every machine and need no counter.  Files and chunks change by one commit that names a version of each, so a failed sweep changes nothing.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from contextlib import contextmanager, nullcontext
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.config import Project, Projects, Settings, is_valid_name
from ..sources.files import Listing, list_roots, scan
from ..sources.store import SnapshotTable
from .chunking import chunked
from .embedding import Embedder, HashingEmbedder, embedded

FILE = "file_id long, repo string, path string, sha256 string, mtime timestamp, size_bytes long, language string, indexed_at timestamp"
CHUNK = "chunk_id long, file_id long, chunk_no int, start_line int, end_line int, symbol string, content string, token_est int, embedding array<float>"
META = "key string, value string"


class Busy(Exception):
    """Another sweep of the project is running."""


def file_id():
    return F.xxhash64("repo", "path")


def actions(existing: DataFrame, found: DataFrame) -> DataFrame:
    """``repo, path, action`` by comparing (repo, path, sha256) tables: insert, update, unchanged or delete."""
    old, new = existing.select("repo", "path", F.col("sha256").alias("old_sha")), found.select("repo", "path", F.col("sha256").alias("new_sha"))
    action = F.when(F.col("new_sha").isNull(), "delete").when(F.col("old_sha").isNull(), "insert").when(F.col("old_sha") == F.col("new_sha"), "unchanged").otherwise("update")
    return old.join(new, ["repo", "path"], "full_outer").select("repo", "path", action.alias("action"))


class Index:
    """One project's tables under ``folder/<project>``."""

    def __init__(self, spark: SparkSession, folder: str, project: str, settings: Settings | None = None, model: Embedder | None = None, buckets: int = 128):
        if not is_valid_name(project):
            raise ValueError(f"project name {project!r} does not match [a-z][a-z0-9_]*")
        self.spark, self.project = spark, project
        self.settings = settings or Settings()
        self.model = model or HashingEmbedder(self.settings.dimension)
        self.folder = f"{folder.rstrip('/')}/{project}"
        # both by file, so that a sweep rewrites the buckets of changed files alone
        self.files = SnapshotTable(spark, f"{self.folder}/files", FILE, keys=["file_id"], buckets=buckets)
        self.chunks = SnapshotTable(spark, f"{self.folder}/chunks", CHUNK, keys=["file_id"], buckets=buckets)
        self.meta = SnapshotTable(spark, f"{self.folder}/meta", META)
        self.files.pin = lambda: self._committed().get("files")
        self.chunks.pin = lambda: self._committed().get("chunks")

    # --- one commit for both tables

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _commits(self) -> list[int]:
        fs, folder = self._fs(f"{self.folder}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _committed(self) -> dict[str, int]:
        """The versions of files and chunks that belong together; empty before the first commit."""
        numbers = self._commits()
        if not numbers:
            return {}
        fs, where = self._fs(f"{self.folder}/commits/{numbers[-1]}.json")
        stream = fs.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, chunks: int, files: int) -> None:
        """Make new versions of both tables count, by one rename; until then readers see the old ones of both."""
        numbers = self._commits()
        after = (numbers or [0])[-1] + 1
        fs, draft = self._fs(f"{self.folder}/commits/_draft-{uuid.uuid4().hex}")
        stream = fs.create(draft)
        try:
            stream.write(bytearray(json.dumps({"chunks": chunks, "files": files}).encode()))
        finally:
            stream.close()
        _, final = self._fs(f"{self.folder}/commits/{after}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer made commit {after} of {self.project}")
        for number in numbers[:-2]:
            fs.delete(self._fs(f"{self.folder}/commits/{number}.json")[1], False)

    def bootstrap(self) -> bool:
        """Create what is missing; True if the project has never been scanned.  Existing meta values win over the seed."""
        seed = {"embedding_model": self.settings.model, "embedding_dim": str(self.model.dimension), "schema_version": "1"}
        self.meta.seed(self.spark.createDataFrame(list(seed.items()), META), ["key"])
        for table in (self.files, self.chunks):
            if not table.version:
                table.truncate()
        return self.files.read().isEmpty()

    def meta_values(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.meta.read().collect()}

    @contextmanager
    def lock(self):
        """A file made exclusively in the project's folder, through the file system that the folder is on."""
        fs, path = self._fs(f"{self.folder}/.lock")
        fs.mkdirs(path.getParent())
        try:
            made = fs.createNewFile(path)
        except Exception:  # noqa: BLE001  a file system may raise where another returns false
            if not fs.exists(path):
                raise
            made = False
        if not made:
            raise Busy(self.project)
        try:
            yield
        finally:
            fs.delete(path, False)

    def break_lock(self) -> None:
        """Drop a lock that a crashed process left."""
        fs, path = self._fs(f"{self.folder}/.lock")
        if fs.exists(path):
            fs.delete(path, False)

    def _verify(self) -> None:
        stated = self.meta_values().get("embedding_dim")
        if stated is not None and int(stated) != self.model.dimension:
            raise ValueError(f"the index has vectors of dimension {stated}, the model gives {self.model.dimension}")

    def sweep(self, project: Project, full: bool = False, locked: bool = False) -> dict:
        """Bring the index up to date; returns the counters that are also stored as ``last_sweep``.

        Where a root cannot be read nothing is deleted for it.  A file that has become binary or blank loses its chunks and counts as deleted.
        """
        with nullcontext() if locked else self.lock():
            self.bootstrap()
            self._verify()
            began = time.time()
            listing = list_roots(project.roots, project.excludes, self.settings.max_file_bytes)
            return self._apply(listing, full, began, [os.path.basename(r) for r in listing.missing])

    def _apply(self, listing: Listing, full: bool, began: float, unreadable: list[str]) -> dict:
        now = datetime.now(timezone.utc)
        old = self.spark.createDataFrame([], FILE) if full else self.files.read()
        seen = written(scan(self.spark, listing).filter("content is not null"), "scan")
        planned = written(actions(old, seen), "actions")
        if unreadable:
            planned = planned.filter(~((F.col("action") == "delete") & F.col("repo").isin(unreadable)))
        changed = seen.join(planned.filter(F.col("action").isin("insert", "update")), ["repo", "path"], "left_semi").withColumn("file_id", file_id())
        pieces = chunked(changed.select("file_id", "content", "language"), "file_id")
        vectors = embedded(pieces.withColumn("chunk_id", F.xxhash64("file_id", "chunk_no")), self.model, max_texts=self.settings.batch_texts, max_bytes=self.settings.batch_bytes)
        fresh = written(vectors, "chunks")
        gone = planned.filter(F.col("action").isin("update", "delete")).select(file_id().alias("file_id"))
        if full:
            gone = self.files.read().select("file_id")
        rows = changed.select("file_id", "repo", "path", "sha256", "mtime", "size_bytes", "language", F.lit(now).alias("indexed_at"))
        counts = {r["action"]: r["count"] for r in planned.groupBy("action").count().collect()}
        made = fresh.count()
        if made or full or counts.get("delete") or counts.get("insert") or counts.get("update"):
            self._commit(self.chunks.merge(gone, fresh), self.files.merge(gone, rows))
        stats = {
            "scanned": len(listing.files),
            "skipped": listing.skipped + len(listing.files) - sum(counts.get(a, 0) for a in ("insert", "update", "unchanged")),
            "indexed": counts.get("insert", 0) + counts.get("update", 0),
            "unchanged": counts.get("unchanged", 0),
            "deleted": counts.get("delete", 0),
            "errored": len(unreadable),
            "chunksInserted": made,
            "elapsedMs": int((time.time() - began) * 1000),
            "fullRebuild": full,
            "completedAt": now.isoformat(),
        }
        self.meta.upsert(self.spark.createDataFrame([("last_sweep", json.dumps(stats))], META), ["key"])
        return stats

    def rebuild(self, project: Project) -> dict:
        """Index everything anew; readers see the old snapshot until the new one is complete."""
        return self.sweep(project, full=True)

    def delete_repo(self, repo: str) -> int:
        """Drop a repository's files and their chunks; returns the number of files."""
        files = self.files.read()
        gone = files.filter(F.col("repo") == repo).select("file_id")
        n = gone.count()
        self._commit(self.chunks.delete(gone), self.files.delete(gone))
        return n

    def drop(self) -> None:
        for table in (self.chunks, self.files, self.meta):
            table.drop()
        fs, commits = self._fs(f"{self.folder}/commits")
        fs.delete(commits, True)

    def status(self) -> dict:
        files, chunks = self.files.read(), self.chunks.read()
        meta = self.meta_values()
        newest = files.agg(F.max("indexed_at")).first()[0]
        return {"project": self.project, "files": files.count(), "chunks": chunks.count(), "last_indexed_at": newest, "meta": meta, "last_sweep": json.loads(meta["last_sweep"]) if "last_sweep" in meta else None}


def reconcile_plan(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """``action, project, repo, n_files`` from two tables: ``configured(project, repo)`` and ``stored(project, repo, n_files)``.

    Actions: drop a stored project, create a configured one, delete or add a repository of a project that both have.
    """
    ours, theirs = configured.select("project").distinct(), stored.select("project").distinct()
    drops = stored.join(ours, "project", "left_anti").groupBy("project").agg(F.sum("n_files").cast("long").alias("n_files")).select(F.lit("drop").alias("action"), "project", F.lit(None).cast("string").alias("repo"), "n_files")
    zero = F.lit(0).cast("long").alias("n_files")
    creates = ours.join(theirs, "project", "left_anti").select(F.lit("create").alias("action"), "project", F.lit(None).cast("string").alias("repo"), zero)
    both = ours.intersect(theirs)
    keys = ["project", "repo"]
    deletes = stored.join(both, "project", "left_semi").join(configured.select(*keys), keys, "left_anti").select(F.lit("delete_repo").alias("action"), *keys, F.col("n_files").cast("long").alias("n_files"))
    adds = configured.join(both, "project", "left_semi").join(stored.select(*keys), keys, "left_anti").select(F.lit("add_repo").alias("action"), *keys, zero)
    return drops.unionByName(creates).unionByName(deletes).unionByName(adds)


class Catalog:
    """All configured projects under one folder."""

    def __init__(self, spark: SparkSession, folder: str, projects: Projects, settings: Settings | None = None, model: Embedder | None = None):
        self.spark, self.folder, self.projects, self.settings, self.model = spark, folder, projects, settings, model

    def index(self, name: str) -> Index:
        return Index(self.spark, self.folder, name, self.settings, self.model)

    def stored(self) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(d for d in names if is_valid_name(d) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{d}/files")))

    def never_scanned(self) -> list[str]:
        return [n for n in self.projects.names if self.index(n).bootstrap()]

    def sweep_all(self) -> dict[str, dict]:
        """Sweep the projects one after the other; a failure or a busy project does not stop the others."""
        out: dict[str, dict] = {}
        for name in self.projects.names:
            try:
                out[name] = self.index(name).sweep(self.projects.get(name))
            except Busy:
                out[name] = {"skipped": "busy"}
            except Exception as e:  # noqa: BLE001  reported, and the next project goes on
                out[name] = {"error": str(e)}
        return out

    def reindex_async(self, name: str, full: bool = False) -> threading.Thread:
        """Start a sweep and return at once; :class:`Busy` if one is running.  The outcome is what the meta table says afterwards."""
        index = self.index(name)
        project = self.projects.get(name)
        held = index.lock()
        held.__enter__()

        def run() -> None:
            try:
                index.sweep(project, full, locked=True)
            finally:
                held.__exit__(None, None, None)

        thread = threading.Thread(target=run, name=f"sweep-{name}", daemon=True)
        thread.start()
        return thread

    def plan_text(self, execute: bool = False) -> str:
        """What differs between configuration and stored projects, one line each, as a proposal or as what was done."""
        words = {"drop": "drop project {project} ({n_files} files)", "create": "create project {project}", "delete_repo": "delete {repo} of {project} ({n_files} files)", "add_repo": "index {repo} of {project} with its next sweep"}
        rows = self.reconcile(execute)
        head = ("Done:" if execute else "Would do:") if rows else "Nothing differs."
        return "\n".join([head, *(f"  {words[r['action']].format(**r)}" for r in rows)])

    def list_projects(self) -> list[dict]:
        return [{"project": n, "files": self.index(n).files.read().count(), "chunks": self.index(n).chunks.read().count()} for n in self.projects.names]

    def reconcile(self, execute: bool = False) -> list[dict]:
        """What differs between configuration and stored projects; on request, carried out."""
        configured = [(n, os.path.basename(r.rstrip("/"))) for n in self.projects.names for r in self.projects.get(n).roots]
        counts = [(n, r["repo"], r["count"]) for n in self.stored() for r in self.index(n).files.read().groupBy("repo").count().collect()]
        empty = [(n, None, 0) for n in self.stored() if n not in {c[0] for c in counts}]
        plan = reconcile_plan(self.spark.createDataFrame(configured, "project string, repo string"), self.spark.createDataFrame(counts + empty, "project string, repo string, n_files long"))
        rows = [r.asDict() for r in plan.filter("repo is not null or action in ('drop', 'create')").orderBy("action", "project", "repo").collect()]
        for row in rows if execute else []:
            index = self.index(row["project"])
            if row["action"] == "drop":
                index.drop()
            elif row["action"] == "create":
                index.bootstrap()
            elif row["action"] == "delete_repo":
                index.delete_repo(row["repo"])
        return rows
