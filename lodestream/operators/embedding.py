"""Embedding of texts by a pluggable model, in batches bounded by count and bytes."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TooLong(Exception):
    """The model does not take texts of this length."""


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic model that needs nothing: signed counts of hashed words and letter triples, normalised.

    Texts that share words are near each other; the same text has the same vector on every machine.
    """

    def __init__(self, dimension: int = 768):
        self.dimension = dimension
        self._known: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"dimension": self.dimension, "_known": {}}

    def _places(self, word: str) -> np.ndarray:
        """Of a word's terms the places, those that count negatively moved up by the dimension."""
        terms = [word, *(f"#{word[k : k + 3]}" for k in range(max(0, len(word) - 2)))]
        hashes = np.array([zlib.crc32(t.encode("utf-8", "replace")) for t in terms], np.int64)
        found = (hashes >> 1) % self.dimension + np.where(hashes & 1, 0, self.dimension)
        if len(self._known) < 200_000 and len(word) < 64:
            self._known[word] = found
        return found

    def _vector(self, text: str) -> np.ndarray:
        known = self._known
        parts = [known[w] if w in known else self._places(w) for w in text.lower().split()]
        if not parts:
            return np.zeros(self.dimension, np.float32)
        counts = np.bincount(np.concatenate(parts), minlength=2 * self.dimension)
        out = (counts[: self.dimension] - counts[self.dimension :]).astype(np.float32)
        size = float(np.linalg.norm(out))
        return out / size if size else out

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        return np.stack([self._vector(t) for t in texts]) if len(texts) else np.zeros((0, self.dimension), np.float32)


class HttpEmbedder:
    """A model behind an HTTP service that takes ``{"model", "input": [...]}`` and answers ``{"embeddings": [[...]]}``."""

    def __init__(self, url: str, model: str, dimension: int, timeout: float = 120.0):
        self.url, self.model, self.dimension, self.timeout = url, model, dimension, timeout

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        request = urllib.request.Request(self.url, json.dumps({"model": self.model, "input": list(texts)}).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                found = json.load(answer)["embeddings"]
        except urllib.error.HTTPError as e:
            if e.code == 400 or "context length" in e.read().decode(errors="replace"):
                raise TooLong(str(e)) from e
            raise
        return np.array(found, np.float32)


def packed(texts: Sequence[str], max_texts: int = 32, max_bytes: int = 6000) -> Iterator[list[str]]:
    """Consecutive texts in batches within both bounds; a batch has one text at least."""
    batch: list[str] = []
    held = 0
    for text in texts:
        size = len(text.encode("utf-8", "replace"))
        if batch and (len(batch) >= max_texts or held + size > max_bytes):
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += size
    if batch:
        yield batch


def embed_range(model: Embedder, texts: Sequence[str]) -> np.ndarray:
    """Embed texts; where the model finds them too long, halve the batch, and a text alone once (if it has over 256 characters)."""
    try:
        return model.embed(texts)
    except TooLong:
        if len(texts) > 1:
            half = len(texts) // 2
            return np.concatenate([embed_range(model, texts[:half]), embed_range(model, texts[half:])])
        if len(texts[0]) <= 256:
            raise
        return model.embed([texts[0][: len(texts[0]) // 2]])


def embedded(chunks: DataFrame, model: Embedder, text_col: str = "content", into: str = "embedding", max_texts: int = 32, max_bytes: int = 6000) -> DataFrame:
    """Adds a vector column; a model that answers with another dimension raises."""
    names = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            parts = [embed_range(model, group) for group in packed(texts, max_texts, max_bytes)]
            vectors = np.concatenate(parts) if parts else np.zeros((0, model.dimension), np.float32)
            if vectors.shape != (len(texts), model.dimension):
                raise ValueError(f"vectors of shape {vectors.shape[1:]}, not {model.dimension}")
            flat = pa.array(vectors.astype(np.float32).ravel())
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * model.dimension)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, flat)], names=[*names, into])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema], f"`{into}` array<float>"])
    return chunks.mapInArrow(run, schema)


def literal(vector: Column) -> Column:
    """A vector as text, ``[a,b,...]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]"))
