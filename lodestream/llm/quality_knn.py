"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are hashed words, word shapes and marks of repetition.  A bounded sample of labelled documents gives inverse document frequencies
and, by truncated singular value decomposition, a projection to ``DIMENSIONS`` latent factors.  The sample's latent vectors are broadcast; every
document's cosines with all of them are computed exactly, in blocks of matrix products, and the labels of the ``NEIGHBOURS`` nearest
vote with their similarity as weight.

The sample has at most ``MAX_LABELLED`` documents, those with the smallest hash of their id, and at most ``BUCKETS`` terms each: 64 MB as a dense
matrix on the driver and about 4 MB broadcast, whatever the corpus size.  Only labelled rows whose id's CRC-32 is not 2
modulo 4 are used.

Scores are functions of the text alone.  Weights, projection and unit vectors are whole multiples of small powers of two, chosen so that every sum of
products fits a double without rounding: cosines do not depend on how texts are blocked.  Of neighbours with equal cosines the one with the
smaller id in the sample comes first, and votes are added in the order of the sample.

Defined results: null and empty texts have the terms of an empty text and are scored like any other; with no labelled rows at all every
score is 0.5; equal texts have equal scores; repeated rows are scored once per row; a row without an id is scored too, its ``held_out`` is null, and it is
never learned from; an id with several labels counts with the smallest, an id with several texts with the one of smallest terms.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, slices

MAX_LABELLED = 4096
BUCKETS = 4096
#: Buckets set aside for word shapes and for marks of repetition.
SHAPES, MARKS = 1024, 64
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 8
CUT = 0.7
#: Steps of one in weights, in the projection and in unit vectors: sums of products stay below 2^53.
WEIGHT_STEPS, FACTOR_STEPS, UNIT_STEPS = 1 << 10, 1 << 17, 1 << 20
#: The weight of a count below 65,536, in steps: one plus its logarithm.
_WEIGHTS = np.array([0, *(round(WEIGHT_STEPS * (1 + math.log(c))) for c in range(1, 1 << 16))], np.int64)

_RUNS = (re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+"))


def _shape(word: bytes) -> bytes:
    """A word with runs of small letters, capitals and digits written as one sign each."""
    word = word[:40]
    for sign, run in zip((b"a", b"A", b"0"), _RUNS, strict=True):
        word = run.sub(sign, word)
    return word


class TermCounter:
    """Turns texts into counts of hashed terms; words seen before keep their buckets."""

    def __init__(self, cache_size: int = 300_000):
        self.cache: dict[bytes, int] = {}
        self.cache_size = cache_size

    def _buckets(self, word: bytes) -> int:
        """The word's bucket and its shape's, in one number."""
        own = MARKS + SHAPES + zlib.crc32(word.lower().strip(b".,;:!?\"'()[]|")) % (BUCKETS - MARKS - SHAPES)
        both = own << 16 | MARKS + zlib.crc32(_shape(word)) % SHAPES
        if len(self.cache) < self.cache_size and len(word) <= 40:
            self.cache[word] = both
        return both

    def terms(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Bucket numbers, ascending, and their weights before document frequencies, in steps: one plus the logarithm of the count."""
        words = text.split()
        n = len(words)
        counts = np.zeros(BUCKETS, np.int64)
        marks: dict[int, int] = {min(15, n.bit_length()): 2}
        if n:
            get = self.cache.get
            both = np.array([get(w) or self._buckets(w) for w in words], np.int64)
            counts += np.bincount(both >> 16, minlength=BUCKETS)
            counts += np.bincount(both & 0xFFFF, minlength=BUCKETS)
            distinct = len(np.unique(both)) / n
            echo = int((both[1:] == both[:-1]).sum()) / (n - 1) if n > 1 else 0.0
            lines = [x for x in text.split(b"\n") if x.strip()]
            again = 1 - len(set(lines)) / len(lines) if lines else 0.0
            marks |= {16 + min(9, int(distinct * 10)): 6, 26 + min(9, int(echo * 10)): 6, 36 + min(9, int(again * 10)): 4}
        at = np.flatnonzero(counts)
        numbers = np.array(sorted(marks), np.int64)
        return np.concatenate([numbers, at]), np.concatenate([np.array([marks[k] * WEIGHT_STEPS for k in numbers], np.int64), _WEIGHTS[np.minimum(counts[at], len(_WEIGHTS) - 1)]])


_counter = TermCounter()


def unit_vectors(samples: list[tuple[np.ndarray, np.ndarray]], projection: np.ndarray) -> np.ndarray:
    """Latent unit vectors of texts given by their terms, in whole steps."""
    out = np.zeros((len(samples), projection.shape[1]))
    for k, (at, weights) in enumerate(samples):
        out[k] = weights.astype(np.float64) @ projection[at]
    out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)
    return np.rint(out * UNIT_STEPS)


@dataclass
class Model:
    """What is broadcast: term weights folded into the projection, the sample's unit vectors (both in steps), and its labels."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, texts: list[bytes]) -> np.ndarray:
        return unit_vectors([_counter.terms(t) for t in texts], self.projection)

    def scores(self, texts: list[bytes], block: int = 256) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        vectors, out = self.latent(texts), np.empty(len(texts))
        n = len(self.labels)
        k = min(NEIGHBOURS, n)
        for start in range(0, len(texts), block):
            products = (vectors[start : start + block] @ self.vectors.T).astype(np.int64)
            # unlike any other key in the row: ties go to the smaller place
            nearest = np.sort(np.argpartition(products * -n + np.arange(n), k - 1, axis=1)[:, :k], axis=1)
            cosines = np.take_along_axis(products, nearest, axis=1) / UNIT_STEPS**2
            likeness = np.maximum(cosines, 0.0) ** SHARPNESS + 1e-9
            out[start : start + block] = [sum(map(float.__mul__, w, y)) / sum(w) for w, y in zip(likeness.tolist(), self.labels[nearest].tolist(), strict=True)]
        return np.clip(out, 0.0, 1.0)


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> Model:
    """Document frequencies and the projection, from the sample's terms; the decomposition is a randomised one with fixed seed."""
    n = len(samples)
    if not n:
        return Model(np.zeros((BUCKETS, dimensions)), np.zeros((0, dimensions)), labels)
    matrix = np.zeros((n, BUCKETS), np.float32)
    for k, (at, weights) in enumerate(samples):
        matrix[k, at] = weights / WEIGHT_STEPS
    rarity = (np.log((1 + n) / (1 + (matrix > 0).sum(axis=0))) + 0.5).astype(np.float32)
    matrix *= rarity
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    width = min(dimensions, n, BUCKETS)
    probe = np.random.default_rng(seed).standard_normal((BUCKETS, min(BUCKETS, width + 16))).astype(np.float32)
    base = matrix @ probe
    for _ in range(4):
        base, _ = np.linalg.qr(base)
        base = matrix @ (matrix.T @ base)
    base, _ = np.linalg.qr(base)
    _, _, factors = np.linalg.svd(base.T @ matrix, full_matrices=False)
    projection = np.zeros((BUCKETS, dimensions))
    projection[:, :width] = np.rint(rarity[:, None] * factors[:width].T * FACTOR_STEPS)
    return Model(projection, unit_vectors(samples, projection), labels)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def sample_of(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list:
    """Terms and label of at most ``limit`` labelled documents outside the held-out part."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(~held_out("doc_id")).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # the documented bound, so the broadcast has one too

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                found = [_counter.terms(t) for t in byte_values(rows.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("label"), pa.array([a.astype("<u2").tobytes() for a, _ in found], pa.binary()), pa.array([w.astype("<u4").tobytes() for _, w in found], pa.binary())],
                    names=["doc_id", "label", "at", "weights"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    terms = texts.mapInArrow(count, "doc_id long, label int, at binary, weights binary")
    # one row for each id, however often it is repeated
    rows = terms.groupBy("doc_id").agg(F.min(F.struct("at", "weights", "label")).alias("t")).select("doc_id", "t.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["weights"], "<u4").astype(np.int64), r["label"]) for r in rows]


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    sample = sample_of(docs, labels, limit, id_col, text_col, label_col)
    model = fit([(a, w) for a, w, _ in sample], np.array([y for _, _, y in sample], np.float64))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                found = shared.value.scores(byte_values(rows.column("text")))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    selected = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = selected.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
