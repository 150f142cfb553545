"""Removal of word passages that occur more than once in the corpus, by level-wise doubling.

A passage of ``WINDOW`` words can only repeat if every shorter window inside it repeats.  The levels have windows of 9, 18 and 35 words, each length
covered by two windows of the one before.  At each level the passages still alive are represented by windows of that length, windows that
occur once in the corpus take their passages out, and what is left goes on to twice the length, until the last level or until no
candidates survive.

Not every short window has to be counted.  Each passage is represented by the one of its windows with the smallest hash (the leftmost of
equals): equal passages choose equal windows, so a repeated passage keeps a repeated representative, and neighbouring passages mostly
share theirs.  The first level then counts about one window in fourteen.  At the last level a passage represents itself, by a hash of 128
bits, so what survives is exact.

What moves.  Texts are shuffled once, at the start, where equal ones become a single row (copies meet on the map side first), and are written in
buckets by their 128-bit key.  From then on every level reads the texts, later the fewer ones still alive, where they lie; only hashes and keys
move.  Hashes are counted by partial aggregation, which also keeps a frequent one from gathering in a task; a hash that is counted
once names the one text it comes from by its key.  A text counts its hashes once for each time it occurs: copies are told by their number.

Defined results: null and empty texts have no words and nothing to remove; texts shorter than the window lose nothing; a repeated
row is a repeated text; windows are judged on the input, not on what is left; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import bucketed, byte_values, slices, text_or_empty

WINDOW = 35
FIRST = 8
SEED = 0x5D


def levels(window: int = WINDOW, first: int = FIRST) -> list[int]:
    """Window lengths that end with ``window``, each covered by two windows of the length before it, none under ``first``."""
    out = [window]
    while (half := -(-out[0] // 2)) >= first:
        out.insert(0, half)
    return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w, SEED) for w in words], np.uint64)


@lru_cache(maxsize=64)
def _multipliers(length: int) -> tuple[int, ...]:
    """Odd multipliers for the places in a window."""
    return tuple(int.from_bytes(hashlib.blake2b(f"{k}".encode(), digest_size=8).digest(), "big") | 1 for k in range(length))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over each other (the finaliser of the XXH64 family)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


def doubled(hashes: np.ndarray, to: int, family: int = 0) -> np.ndarray:
    """Hashes of all windows of ``to`` words, built by doubling: a window's hash is made of those of its two halves.

    A length that is no power of two is covered by two overlapping windows of the greatest power of two below it.  Families are independent.
    """
    even, odd = (np.uint64(m) for m in _multipliers(2 * family + 2)[-2:])
    length, now = 1, hashes
    while length * 2 <= to:
        now = _mixed(now[:-length] * even + _mixed(now[length:])) if len(now) > length else now[:0]
        length *= 2
    if length < to:
        rest = to - length
        now = _mixed(now[:-rest] * odd + _mixed(now[rest:])) if len(now) > rest else now[:0]
    return now


def representatives(found: np.ndarray, passages: int) -> np.ndarray:
    """For each of ``passages`` passages, the place of the smallest hash among its windows, the leftmost of equals."""
    span = len(found) - passages + 1
    if span == 1:
        return np.arange(passages)
    # minima over runs by doubling, as pairs of hash and place
    place, length = np.arange(len(found)), 1
    while length < span:
        step = min(length, span - length)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(found[right] < found[left], right, left)
        length += step
    return place


def _runs(flags: np.ndarray) -> bytes:
    """Starts and ends of the runs of true values, as 32-bit integers."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges.astype("<i4").tobytes()


def _flags(runs: bytes, n: int) -> np.ndarray:
    marks = np.zeros(n + 1, np.int32)
    edges = np.frombuffer(runs, "<i4")
    np.add.at(marks, edges[::2], 1)
    np.add.at(marks, edges[1::2], -1)
    return np.cumsum(marks[:-1]) > 0


def _candidates(words: np.ndarray, alive: np.ndarray | None, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of this level's windows, the representative of each passage, and which passages are alive."""
    found = doubled(words, length)
    passages = len(words) - window + 1
    return found, representatives(found, passages), np.ones(passages, bool) if alive is None else alive


def _opening(words: list[bytes], length: int, window: int) -> np.ndarray:
    """The hashes, one for each place, of the representatives of all passages of a text."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    found, chosen, _ = _candidates(word_hashes(words), None, length, window)
    return found[np.unique(chosen)]


def among(lone: np.ndarray, lone_second: np.ndarray | None, mine: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    """Which of ``mine`` are in ``lone``; with seconds, the pairs of both hashes are compared."""
    order = np.argsort(lone, kind="stable")
    single = lone[order]
    at = np.minimum(np.searchsorted(single, mine), len(single) - 1)
    same = single[at] == mine
    if second is None or lone_second is None:
        return same
    if len(np.unique(single)) == len(single):
        return same & (lone_second[order][at] == second)
    pairs = set(zip(lone.tolist(), lone_second.tolist(), strict=True))
    return np.array([pair in pairs for pair in zip(mine.tolist(), second.tolist(), strict=True)], bool)


def _joined_digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def removed_words(words: int, alive: np.ndarray, window: int) -> np.ndarray:
    """Which words the alive passages cover."""
    marks = np.zeros(words + 1, np.int32)
    starts = np.flatnonzero(alive)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return np.cumsum(marks[:-1]) > 0


KEY = ["k1", "k2"]


def _lone(rows: DataFrame, hashes: list[str]) -> DataFrame:
    """``k1, k2`` and one array for each of ``hashes``: of each text those that occur at one place of the corpus only.

    ``rows`` has the key, ``copies`` (how often the text occurs) and arrays of equal length.  A hash that one text has twice comes twice in
    its arrays.  Where the count is one, the least key is the only one.  Texts with copies can lend no lone hash, so they count two at least.
    """
    exploded = rows.select(*KEY, "copies", F.explode(F.arrays_zip(*hashes)).alias("h")).select(*KEY, "copies", "h.*")
    counted = exploded.groupBy(*hashes).agg(F.sum(F.least("copies", F.lit(2))).alias("n"), *[F.min(k).alias(k) for k in KEY])
    listed = counted.filter("n = 1").groupBy(*KEY).agg(F.collect_list(F.struct(*hashes)).alias("l"))
    return listed.select(*KEY, *[F.col(f"l.{h}").alias(h) for h in hashes])


def key_of(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text: the second is seeded by a hash of 1."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def passages(docs: DataFrame, text_col: str = "text", window: int = WINDOW, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """Two tables by text: ``k1, k2, n_words, whole_sha256`` of every text, and ``k1, k2, text, runs`` of those with repeated passages.

    ``k1, k2`` are two hashes of a text, its key; ``runs`` holds starts and ends of the runs of repeated passages' first words.
    """
    ladder = levels(window, first)
    keyed = docs.select(text_or_empty(text_col).alias("text")).select("text", *key_of(F.col("text")))
    texts = bucketed(keyed.groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies")), "distinct-texts", KEY)

    def open_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                sizes, digests, hashes = [], [], []
                for text in byte_values(rows.column("text")):  # one text's words at a time
                    words = text.split()
                    sizes.append(len(words))
                    digests.append(_joined_digest(words))
                    hashes.append(_opening(words, ladder[0], window).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in (*KEY, "copies")), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(hashes, pa.list_(pa.int64()))],
                    names=[*KEY, "copies", "n_words", "whole_sha256", "hash"],
                )

    opened = written(texts.mapInArrow(open_level, "k1 long, k2 long, copies long, n_words long, whole_sha256 string, hash array<long>"), "opened-texts")

    def close_level(length: int, then: int | None):
        """Drop the passages whose representative at ``length`` occurs once; list the representatives for the next level."""

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in slices(batch, "text"):
                    out: list[tuple] = []
                    lone = rows.column("hash")
                    lone_second = rows.column("second") if then is None else None
                    for k, (k1, k2, copies, runs, text) in enumerate(zip(*(rows.column(c).to_pylist() for c in (*KEY, "copies", "runs")), byte_values(rows.column("text")), strict=True)):
                        words = text.split()
                        if len(words) < window:
                            continue
                        hashes = word_hashes(words)
                        found, chosen, alive = _candidates(hashes, None if runs is None else _flags(runs, len(words) - window + 1), length, window)
                        if lone[k].is_valid:
                            single = lone[k].values.to_numpy().view(np.uint64)
                            if lone_second is None:
                                alive = alive & ~among(single, None, found[chosen], None)
                            else:
                                alive = alive & ~among(single, lone_second[k].values.to_numpy().view(np.uint64), found[chosen], doubled(hashes, length, 1)[chosen])
                        if not alive.any():
                            continue
                        following = second = None
                        if then is not None:
                            found, chosen, _ = _candidates(hashes, alive, then, window)
                            at = np.unique(chosen[alive])
                            following = found[at].view(np.int64)
                            second = doubled(hashes, then, 1)[at].view(np.int64) if then == window else None
                        out.append((k1, k2, copies, text, _runs(alive), following, second))
                    if out:
                        k1, k2, copies, text, runs, following, second = (list(c) for c in zip(*out, strict=True))
                        longs = pa.list_(pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(copies, pa.int64()), pa.array([t.decode() for t in text], pa.string()), pa.array(runs, pa.binary()), pa.array(following, longs), pa.array(second, longs)],
                            names=[*KEY, "copies", "text", "runs", "hash", "second"],
                        )

        return step

    # the last level compares 128 bits, the others 64
    if len(ladder) == 1:  # the only level is the last one

        def seconds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    found = [doubled(word_hashes(t.split()), window, 1).view(np.int64) for t in byte_values(part.column("text"))]
                    firsts = [_opening(t.split(), window, window).view(np.int64) for t in byte_values(part.column("text"))]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*KEY, "copies")), pa.array(firsts, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))], names=[*KEY, "copies", "hash", "second"])

        rows = texts.mapInArrow(seconds, "k1 long, k2 long, copies long, hash array<long>, second array<long>")
    else:
        rows = opened.select(*KEY, "copies", "hash")
    state = texts.select(*KEY, "copies", "text", F.lit(None).cast("binary").alias("runs"))
    for length, then in zip(ladder, [*ladder[1:], None], strict=True):
        hashes = ["hash"] if then is not None else ["hash", "second"]
        lone = written(_lone(rows, hashes), f"lone-{length}")
        judged = state.select(*KEY, "copies", "text", "runs").join(lone, KEY, "left")
        step = judged.mapInArrow(close_level(length, then), "k1 long, k2 long, copies long, text string, runs binary, hash array<long>, second array<long>")
        state = bucketed(step, f"level-{length}", KEY)
        if state.isEmpty():
            break
        rows = state.select(*KEY, "copies", "hash", "second")
    return opened.select(*KEY, "n_words", "whole_sha256"), state.select(*KEY, "text", "runs")


def _cut(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Per text with repeated passages: ``k1, k2, n_removed, kept_sha256`` and, on request, ``kept``, its words joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                removed, kept = [], []
                for text, runs in zip(byte_values(rows.column("text")), rows.column("runs").to_pylist(), strict=True):
                    words = text.split()
                    gone = removed_words(len(words), _flags(runs, len(words) - window + 1), window)
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone)]))
                columns = [rows.column("k1"), rows.column("k2"), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                if with_text:
                    columns.append(pa.array([k.decode() for k in kept], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "n_removed", "kept_sha256", "kept"][: len(columns)])

    schema = "k1 long, k2 long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return texts.select(*KEY, "text", "runs").mapInArrow(cut, schema)


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row."""
    whole, texts = passages(docs, text_col, window)
    cut = written(_cut(texts, window, False), "cut")
    judged = written(
        whole.join(cut, KEY, "left").select(*KEY, "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")), "judged-texts"
    )
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), *key_of(text_or_empty(text_col))), "rows")
    return rows.join(judged, KEY).select("doc_id", "n_words", "n_removed", "kept_sha256")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without their repeated passages, columns unchanged.

    A text that loses words becomes its kept words joined by one space; any other text stays as it is.
    """
    _, texts = passages(docs, text_col, window)
    names = ["_k1", "_k2", "_kept"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    cut = written(_cut(texts, window, True), "cut").select(*[F.col(c).alias(n) for c, n in zip([*KEY, "kept"], names, strict=True)])
    keyed = docs.withColumns(dict(zip(names, key_of(text_or_empty(text_col)), strict=False)))
    return keyed.join(cut, names[:2], "left").withColumn(text_col, F.coalesce(names[2], text_col)).select(*docs.columns)
