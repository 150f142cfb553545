"""Vector search and lookups over an index of files and chunks.

The scan is exact: every vector that passes the filters is compared, each task keeps its own best ``k`` and the best of those are merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .embedding import Embedder

K, MOST = 8, 50
SNIPPET = 300


def cosine(vector: Column, query: Sequence[float] | Column) -> Column:
    """Cosine similarity in double precision; NaN where either vector is zero."""
    other = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(vector, other, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), add)
    square = lambda v: F.aggregate(F.transform(v, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), add)
    norms = F.sqrt(square(vector)) * F.sqrt(square(other))
    return F.when(norms > 0, dot / F.when(norms > 0, norms)).otherwise(F.lit(float("nan")))


def score(similarity: Column) -> Column:
    """Three decimals, halves up; NaN as 0."""
    return F.when(F.isnan(similarity), F.lit(0.0)).otherwise(F.floor(similarity * 1000 + 0.5) / 1000)


def top_k(vectors: DataFrame, query: Sequence[float], k: int = K, vector_col: str = "embedding", id_col: str = "chunk_id") -> DataFrame:
    """The ``k`` rows nearest to a query vector, ties by id, with their similarity in ``sim``; zero vectors come last."""
    found = vectors.withColumn("sim", cosine(F.col(vector_col), query))
    rank = F.when(F.isnan("sim"), F.lit(-2.0)).otherwise(F.col("sim"))
    return found.orderBy(rank.desc(), F.col(id_col)).limit(k)


def clamped(k: int | None) -> int:
    return max(1, min(MOST, K if k is None else k))


def snippet(content: Column, length: int = SNIPPET) -> Column:
    return F.when(F.length(content) > length, F.concat(F.substring(content, 1, length), F.lit("..."))).otherwise(F.coalesce(content, F.lit("")))


def absolute_path(repo: Column, path: Column, roots: Sequence[str]) -> Column:
    """The path under the root of that name (the last of equals); the path as it is where no root has the name."""
    by_name = {r.rstrip("/").rpartition("/")[2]: r.rstrip("/") for r in roots}
    root = F.try_element_at(F.create_map(*[F.lit(x) for pair in by_name.items() for x in pair]), repo) if by_name else F.lit(None).cast("string")
    return F.coalesce(F.concat(root, F.lit("/"), path), path)


def windows_path(path: Column, distribution: str) -> Column:
    """Mounted drives as drive letters, other absolute paths under the distribution's share, relative paths as they are."""
    slashes = lambda c: F.replace(c, F.lit("/"), F.lit("\\"))
    drive = F.concat(F.upper(F.substring(path, 6, 1)), F.lit(":"), F.when(F.length(path) > 6, slashes(F.substring(path, 7, 100_000))).otherwise(F.lit("\\")))
    return F.when(path.rlike("^/mnt/[a-zA-Z](/|$)"), drive).when(path.startswith("/"), F.concat(F.lit(f"\\\\wsl$\\{distribution}"), slashes(path))).otherwise(path)


def filtered(files: DataFrame, repo: str | None = None, language: str | None = None, path_prefix: str | None = None) -> DataFrame:
    """Files of a repository, of a language, under a prefix; the prefix is a LIKE pattern, so ``_`` and ``%`` in it match anything."""
    if repo:
        files = files.filter(F.col("repo") == repo)
    if language:
        files = files.filter(F.col("language") == language)
    if path_prefix:
        files = files.filter(F.col("path").like(path_prefix + "%"))
    return files


def search(files: DataFrame, chunks: DataFrame, query: Sequence[float], k: int | None = None, repo: str | None = None, language: str | None = None, path_prefix: str | None = None, roots: Sequence[str] = ()) -> DataFrame:
    """The chunks nearest to a query vector: ``chunk_id, repo, path, absolute_path, start_line, end_line, symbol, score, snippet``.

    Files are far fewer than chunks; whether their side is broadcast is left to the planner, which knows its size.  At most ``MOST`` rows, those found,
    come to the driver; their contents are then looked up.
    """
    chosen = filtered(files, repo, language, path_prefix).select("file_id", "repo", "path")
    # the scan reads no contents; the few best rows are then looked up by id, a filter that reaches the scan
    best = top_k(chunks.select("chunk_id", "file_id", "start_line", "end_line", "symbol", "embedding").join(chosen, "file_id"), query, clamped(k)).drop("embedding")
    rows = best.collect()
    found = chunks.sparkSession.createDataFrame(rows, best.schema)
    contents = chunks.filter(F.col("chunk_id").isin([r["chunk_id"] for r in rows])).select("chunk_id", "content")
    rank = F.when(F.isnan("sim"), F.lit(-2.0)).otherwise(F.col("sim"))
    hits = found.join(contents, "chunk_id").orderBy(rank.desc(), "chunk_id").select(
        "chunk_id", "repo", "path", absolute_path(F.col("repo"), F.col("path"), roots).alias("absolute_path"), "start_line", "end_line", "symbol", score(F.col("sim")).alias("score"), snippet(F.col("content")).alias("snippet")
    )
    return hits


def search_text(files: DataFrame, chunks: DataFrame, model: Embedder, text: str, **options) -> DataFrame:
    if not (text or "").strip():
        raise ValueError("an empty query")
    return search(files, chunks, [float(x) for x in model.embed([text])[0]], **options)


def get_chunk(files: DataFrame, chunks: DataFrame, chunk_id: int) -> dict:
    row = chunks.filter(F.col("chunk_id") == chunk_id).join(files.select("file_id", "repo", "path", "language"), "file_id").drop("embedding").first()
    if row is None:
        raise KeyError(f"no chunk {chunk_id}")
    return row.asDict()


def list_repos(files: DataFrame) -> DataFrame:
    """``repo, files, bytes`` by repository."""
    return files.groupBy("repo").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")).orderBy("repo")


def index_status(files: DataFrame, chunks: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row: ``files, chunks, last_indexed_at`` and, of a meta table, its entries as a map."""
    counted = files.agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed_at")).join(chunks.agg(F.count("*").alias("chunks")))
    if meta is None:
        return counted
    return counted.join(meta.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta")))
