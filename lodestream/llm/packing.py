"""Concatenate and cut: fixed-length training sequences out of one global token stream.

Pass one tokenises every document once and writes ``(doc_id, part, before, n_tokens, ids)``, where ``before`` is the number of
tokens that precede the document inside its task.  The totals of the tasks (one row per task) are summed into the offset at
which each task's tokens start.  Pass two adds the two offsets and cuts the stream every ``length`` tokens.  No step orders or
gathers documents: the only data that leave a task are the task totals.

Defined results: a null or empty text gives the end token alone; repeated rows are packed once per row; a document may be longer
than a sequence and is then cut into several pieces; an empty table gives no pieces; only the last sequence can be short.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import byte_values, places, slices

LENGTH = 2048
END_ID = 1
#: Task totals up to this many rows are broadcast (16 bytes each); beyond it the join is left to the planner.
BROADCAST_TOTALS = 1_000_000


#: Stands for the ids of a chunk that is not remembered; no real ids have this length.
UNKNOWN = b"?"


class ChunkTokenizer:
    """Token ids, as little-endian 32-bit words, of texts whose tokens never span ASCII white space.

    A text's ids are then those of its white-space separated chunks one after the other, so each distinct chunk is encoded once
    and remembered (the first ``cache_size`` chunks of at most 48 bytes).  Unknown chunks are encoded together: letters with
    trailing punctuation are two words of the tokenizer, and a word of letters ends with the first token that ends a word.
    Any other chunk is told apart by the end-of-text string, and chunks that hold special strings themselves go alone.
    """

    def __init__(self, path: str, cache_size: int = 500_000, separator: str = "<|endoftext|>", word_end: str = "</w>"):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same merges for words that are lower-case, composed letters already: nothing to normalise or to tell apart but spaces.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.separator = separator
        self.separator_id = self.tokenizer.token_to_id(separator)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends_word[number] = token.endswith(word_end)
        self.cache: dict[bytes, bytes] = {}
        self.cache_size = cache_size

    def _encode(self, text: str, tokenizer=None) -> np.ndarray:
        encoded = (tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(encoded.ids, dtype="<u4")

    def _apart(self, chunks: list[str], joint: str, is_end: np.ndarray, keep_end: int, tokenizer=None) -> dict[str, bytes]:
        """Ids of each chunk, all encoded in one call; a chunk's ids end with the next id that ``is_end`` marks."""
        found: dict[str, bytes] = {}
        for start in range(0, len(chunks), 20_000):
            group = chunks[start : start + 20_000]
            ids = self._encode(joint.join(group) + ("" if keep_end else joint), tokenizer)
            ends = np.flatnonzero(is_end[ids])
            if len(ends) != len(group):
                raise ValueError("the tokenizer did not keep the chunks apart")
            raw, stops = ids.tobytes(), (4 * (ends + keep_end)).tolist()
            begins = [0, *(4 * (ends + 1)).tolist()]
            found.update((c, raw[a:b]) for c, a, b in zip(group, begins, stops, strict=False))
        return found

    def _learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        words, other, cut = set(), [], {}
        for chunk in chunks:
            base = chunk.rstrip(b".,!?;:|")
            if base == base.lower() and (base.isalpha() or ((text := base.decode()).isalpha() and text.lower().isalpha())):
                words.add(base)
                cut[chunk] = base
            elif b"<|" in chunk or b"|>" in chunk or len(chunk) > 10_000:
                found[chunk] = self._encode(chunk.decode()).tobytes()
            else:
                other.append(chunk.decode())
        ids = {c: b for c in words if (b := self.cache.get(c)) is not None}
        fresh = [c.decode() for c in words if c not in ids]
        ready = [w.isascii() or (w.lower() == w and unicodedata.is_normalized("NFC", w)) for w in fresh]  # ASCII is lower-case here
        for tokenizer, group in ((self.plain, [w for w, x in zip(fresh, ready, strict=True) if x]), (self.tokenizer, [w for w, x in zip(fresh, ready, strict=True) if not x])):
            ids.update((c.encode(), b) for c, b in self._apart(group, " ", self.ends_word, 1, tokenizer).items())
        marks: dict[bytes, bytes] = {b"": b""}
        for chunk, base in cut.items():
            if (mark := chunk[len(base) :]) not in marks:
                marks[mark] = self._encode(mark.decode()).tobytes()
            found[chunk] = ids[base] + marks[mark]
        special = np.zeros(len(self.ends_word), dtype=bool)
        special[self.separator_id] = True
        found.update((c.encode(), b) for c, b in self._apart(other, self.separator, special, 0).items())
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]  # ASCII case only; special strings keep theirs
        ids = [list(map(self.cache.get, chunks, itertools.repeat(UNKNOWN))) for chunks in split]
        holes = [list(places(known, UNKNOWN)) for known in ids]
        missing = {chunks[i] for chunks, own in zip(split, holes, strict=True) for i in own}
        if missing:
            learnt = self._learn(missing)
            for chunks, known, own in zip(split, ids, holes, strict=True):
                for i in own:
                    known[i] = learnt[chunks[i]]
            if (room := self.cache_size - len(self.cache)) > 0:
                self.cache.update([(c, b) for c, b in learnt.items() if len(c) <= 48][:room])
        return [b"".join(x) for x in ids]


_tokenizers: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer per Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``doc_id, part, before, n_tokens, ids``, written to the shared folder; ``ids`` ends with ``end_id``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_tokenizer(tokenizer_path)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text"):
                ids = [x + end for x in encoder.encode(byte_values(rows.column("text")))]
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.full(len(ids), part, np.int64)), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )

    selected = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = selected.mapInArrow(encode, "doc_id long, part long, before long, n_tokens long, ids binary")
    return written(out, "tokens")


def placed(tokens: DataFrame) -> DataFrame:
    """Adds ``at``, the place of each document's first token in the whole stream."""
    spark = tokens.sparkSession
    totals = sorted(tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row per task
    base, starts = 0, []
    for part, n in totals:
        starts.append((part, base))
        base += n
    bases = spark.createDataFrame(starts, "part long, base long")
    if len(starts) <= BROADCAST_TOTALS:
        bases = F.broadcast(bases)
    return tokens.join(bases, "part").withColumn("at", F.col("base") + F.col("before")).drop("part", "base", "before")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``start`` counts the document's tokens before the piece, ``offset`` the sequence's.  Every token lies in one piece.
    """
    at = placed(tokenized(docs, tokenizer_path, id_col, text_col, end_id))
    windows = F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n_tokens") - 1) / length))

    def piece(window):
        start = F.greatest(window * length - F.col("at"), F.lit(0))
        stop = F.least((window + 1) * length - F.col("at"), F.col("n_tokens"))
        return F.struct(
            start.cast("long").alias("start"),
            (stop - start).cast("long").alias("length"),
            F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((stop - start) * 4).cast("int")).alias("ids"),
            window.cast("long").alias("sequence_id"),
            (F.col("at") + start - window * length).cast("long").alias("offset"),
        )

    cut = at.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    return cut.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """Assemble ``sequence_id, ids, n_tokens, boundaries``: ``ids`` padded to ``length``, ``boundaries`` the document starts.

    A group holds at most ``length`` tokens, so no task can be handed an unbounded group.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "start", "doc_id", "ids")))
    grouped = pieces.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(np.array([pad_id], "<u4").tobytes().hex()), (F.lit(length) - F.col("n_tokens")).cast("int")))
    firsts = F.transform(F.filter("p", lambda x: x["start"] == 0), lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id")))
    return grouped.select("sequence_id", F.concat(joined, pad).alias("ids"), "n_tokens", firsts.alias("boundaries"))


def with_crc(pieces: DataFrame) -> DataFrame:
    """The digest form of :func:`pack`: the ids replaced by their CRC-32."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
