"""Scan of source trees: listing on the driver, contents on the executors.

The listing skips excluded subtrees before it enters them and looks at sizes and names before any content is read.  It includes names that
begin with a dot or an underscore, which Spark's own file listing leaves out.  Roots must be mounted on the driver and the executors.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .languages import as_text, is_binary, language_of

MAX_BYTES = 1_048_576
LISTING = "repo string, path string, root string, size_bytes long, mtime timestamp, language string"


def glob_to_regex(glob: str) -> str:
    """A path glob as a regular expression for the whole path.

    ``*`` and ``?`` stay within a name, ``**`` goes across names, ``[...]`` is a set (``!`` negates), ``{a,b}`` are alternatives.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if glob[i : i + 2] == "**":
                out.append(".*")
                i += 1
            else:
                out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"an open set in {glob!r}")
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("(?!/)[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"an open group in {glob!r}")
    return "".join(out)


@dataclass
class Listing:
    """Files found, roots that could not be read, and how many files were skipped."""

    files: list[tuple] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    skipped: int = 0


def list_roots(roots: Sequence[str], excludes: Sequence[str] = (), max_bytes: int = MAX_BYTES) -> Listing:
    """Walk the roots.  A glob that matches an absolute path leaves out that file or that whole folder."""
    from datetime import datetime, timezone

    patterns = [re.compile(glob_to_regex(g), re.DOTALL) for g in excludes]
    excluded = lambda p: any(x.fullmatch(p) for x in patterns)
    out = Listing()
    for root in roots:
        root = os.path.abspath(root)
        if not os.path.isdir(root):
            out.missing.append(root)
            continue
        repo = os.path.basename(root)
        for folder, folders, names in os.walk(root):
            folders[:] = sorted(d for d in folders if not excluded(os.path.join(folder, d)))
            for name in sorted(names):
                path = os.path.join(folder, name)
                if excluded(path) or not os.path.isfile(path):
                    continue
                info, language = os.stat(path), language_of(name)
                if info.st_size > max_bytes or language is None:
                    out.skipped += 1
                    continue
                when = datetime.fromtimestamp(info.st_mtime, tz=timezone.utc)
                out.files.append((repo, os.path.relpath(path, root), root, info.st_size, when, language))
    return out


def scan(spark: SparkSession, listing: Listing, partition_bytes: int = 32 << 20) -> DataFrame:
    """``repo, path, language, size_bytes, mtime, sha256, content`` of text files; contents are read where they are used.

    ``content`` is null for a file that looks binary, that is blank, or that went away in the meantime.
    """
    if not listing.files:
        return spark.createDataFrame([], "repo string, path string, language string, size_bytes long, mtime timestamp, sha256 string, content string")
    total = sum(f[3] for f in listing.files)
    files = spark.createDataFrame(listing.files, LISTING).repartition(max(1, total // partition_bytes), "repo", "path")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                try:
                    with open(os.path.join(one.column("root")[0].as_py(), one.column("path")[0].as_py()), "rb") as f:
                        data = f.read()
                except OSError:
                    data = None
                columns = [one.column(c) for c in ("repo", "path", "language", "size_bytes", "mtime")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], names=["repo", "path", "language", "size_bytes", "mtime", "bytes"])

    read = files.mapInArrow(load, "repo string, path string, language string, size_bytes long, mtime timestamp, bytes binary")
    text = F.when(~is_binary(F.col("bytes")), as_text(F.col("bytes")))
    return read.select("repo", "path", "language", "size_bytes", "mtime", F.sha2("bytes", 256).alias("sha256"), F.when(text.rlike(r"[^\x00-\x20]"), text).alias("content"))


def write_text(spark: SparkSession, path: str, text: str, append: bool = False) -> None:
    """Write one file, or add to it, on any file system that Spark reaches; where a system cannot append the file is written anew."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    before = read_text(spark, path) if append and fs.exists(where) else ""
    stream = fs.create(where, True)
    try:
        stream.write(bytearray((before + text).encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The whole text of one file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
