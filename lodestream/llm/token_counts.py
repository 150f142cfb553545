"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

For a merge-type vocabulary a sequence of pieces is the encoding of its text exactly if every two neighbours are the encoding of
their own text.  So the last piece of a prefix is the one piece that ends there and fits the last piece of the prefix before it:
``count(prefix) = count(prefix without its last piece) + 1``.  One pass from left to right stores the count at every prefix, and any
truncation or budget question ("how much of this text fits in 4096 tokens?") is answered from the table, without encoding again.

States are remembered by prefix of a segment, so words share the work of their common beginnings.

Defined results: null and empty texts have no tokens and a table that holds one zero; characters outside the vocabulary count their
UTF-8 bytes; the prefixes are those after each code point.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_values
from .pieces import CUT, MARK, load, segments

LIMIT = 4096
#: States are remembered for prefixes of segments up to this many characters.
KEPT_PREFIX = 7
#: Sizes to try where no longer piece ends.
SHORT = (2, 1)


class PrefixCounter:
    def __init__(self, path: str, cache_size: int = 300_000, state_size: int = 500_000):
        self.pieces = load(path)
        self.cache: dict[str, np.ndarray | bytes] = {}
        self.cache_size = cache_size
        #: Last piece and count at a prefix of a segment.
        self.states: dict[str, tuple[str, int]] = {}
        self.state_size = state_size
        self.fits: dict[str, dict[str, bool]] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        #: Sizes of the pieces that end with three given characters, largest first, and then 2 and 1.
        found: dict[str, set[int]] = {}
        for piece in self.pieces.id:
            if len(piece) > 2:
                found.setdefault(piece[-3:], {1, 2}).add(len(piece))
        self.sizes = {tail: tuple(sorted(sizes, reverse=True)) for tail, sizes in found.items()}

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge gives ``piece``; None for a single character and for a piece that merging never gives."""
        if piece not in self.halves:
            found = None
            if len(piece) > 1:
                # what is left with the piece itself out of the vocabulary are the parts of its last merge
                rank = self.pieces.rank
                saved = rank.pop(piece)
                parts = self.pieces.merge(piece)
                rank[piece] = saved
                found = (parts[0], parts[1]) if len(parts) == 2 else None
            self.halves[piece] = found
        return self.halves[piece]

    def _fit(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` gives these two pieces.

        Merges are undone from the latest backwards; the two stay apart unless a pair across the border would have merged
        earlier than the merge undone last.  Mark-only pieces share one rank, so these are merged outright.
        """
        rank = self.pieces.rank
        if left[-1] == MARK or right[0] == MARK or (len(right) > 1 and self._halves(right) is None):
            return self.pieces.merge(left + right) == [left, right]
        limit = len(rank) + 1
        while True:
            across = rank.get(left + right)
            if across is not None and across < limit:
                return False
            one, two = self._halves(left), self._halves(right)
            if one is not None and (two is None or rank[left] > rank[right]):
                limit, left = rank[left], one[1]
            elif two is not None:
                limit, right = rank[right] + 1, two[0]
            else:
                return True

    def prefix_counts(self, segment: str) -> list[int]:
        """Tokens of ``segment[:i]`` for i from 1 to its length."""
        states, ids, sizes, all_fits = self.states, self.pieces.id, self.sizes, self.fits
        lasts: list[str] = [""]
        counts: list[int] = [0]
        for i in range(1, len(segment) + 1):
            state = states.get(segment[:i]) if i <= KEPT_PREFIX else None
            if state is None:
                for size in sizes.get(segment[i - 3 : i], SHORT) if i > 2 else SHORT:
                    if size > i or (piece := segment[i - size : i]) not in ids:
                        continue
                    before = lasts[i - size]
                    if not before:
                        if size > 1 and self._halves(piece) is None:
                            continue
                    else:
                        fits = all_fits.get(before)
                        if fits is None:
                            if len(all_fits) > 50_000:
                                all_fits.clear()
                            fits = all_fits[before] = {}
                        fit = fits.get(piece)
                        if fit is None:
                            fit = fits[piece] = self._fit(before, piece)
                        if not fit:
                            continue
                    state = (piece, counts[i - size] + 1)
                    break
                else:
                    state = (segment[i - 1], counts[i - 1] + len(segment[i - 1].encode()))
                if i <= KEPT_PREFIX and len(states) < self.state_size:
                    states[segment[:i]] = state
            lasts.append(state[0])
            counts.append(state[1])
        return counts[1:]

    def _counts(self, part: str) -> bytes | np.ndarray:
        """The counts of a segment that is not remembered, from those of its independent cuts."""
        cuts = CUT.split(part)
        if len(cuts) == 1 or len(cuts) > 6:
            counts = self.prefix_counts(part)
            small = len(part) <= 60_000 and counts[-1] < 60_000
            known = np.array(counts, "<u2").tobytes() if small else np.array(counts, np.int32)
        else:
            known, total = b"", 0
            for cut in cuts:
                got = self.cache.get(cut) or self._counts(cut)
                if type(got) is not bytes or total + got[-2] + 256 * got[-1] >= 60_000:
                    return np.array(self.prefix_counts(part), np.int32)
                known += (np.frombuffer(got, "<u2") + np.uint16(total)).tobytes() if total else got
                total = known[-2] + 256 * known[-1]
        if len(self.cache) < self.cache_size and len(part) <= 32:
            self.cache[part] = known
        return known

    def table(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for i from 0 to its length, as 32-bit integers."""
        parts = segments(text)
        if not parts:
            return np.zeros(1, np.int32)
        cache = self.cache
        found = list(map(cache.get, parts))
        wide = False
        if None in found:
            for at, known in enumerate(found):
                if known is None:
                    part = parts[at]
                    found[at] = cache.get(part) or self._counts(part)
                    wide = wide or type(found[at]) is not bytes
        if not wide:
            within = np.frombuffer(b"".join(found), "<u2").astype(np.int32)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        else:  # a long segment's counts are an array; joining would take its bytes without complaint
            own = [np.frombuffer(x, "<u2") if type(x) is bytes else x for x in found]
            within = np.concatenate([np.asarray(x, np.int32) for x in own])
            sizes = np.array([len(x) for x in own])
        ends = np.cumsum(sizes)
        totals = np.cumsum(within[ends - 1])
        base = np.repeat(totals - within[ends - 1], sizes)
        return np.concatenate([np.zeros(1, np.int32), (base + within)[1:].astype(np.int32)])  # the mark in front is no character of the text


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per Python worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def fitting(table: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens; counts of longer prefixes may fall again."""
    return int(np.flatnonzero(table <= budget)[-1])


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", budgets: Sequence[int] = (LIMIT,), with_table: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, fits`` and, on request, ``prefix_tokens``.

    ``fits`` maps each budget to the code points of the longest prefix within it.  ``prefix_tokens`` holds the count at every prefix
    as little-endian 32-bit integers (read with :func:`counts_at`).
    """
    budgets = tuple(budgets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(model_path).table
        for batch in batches:
            for rows in slices(batch, "text"):
                texts = text_values(rows.column("text"))
                found = [tables(t) for t in texts]
                columns = [
                    rows.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([int(x[-1]) for x in found], pa.int64()),
                    pa.array([[(b, fitting(x, b) if x[-1] > b else len(x) - 1) for b in budgets] for x in found], pa.map_(pa.int64(), pa.int64())),
                ]
                if with_table:
                    columns.append(pa.array([x.astype("<i4").tobytes() for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "fits", "prefix_tokens"][: len(columns)])

    selected = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_bytes long, n_tokens long, fits map<bigint,bigint>" + ", prefix_tokens binary" * with_table
    return selected.mapInArrow(count, schema)


def counts_at(prefix_tokens: bytes) -> np.ndarray:
    """The table of a row: the entry at i is the token count of the first i code points."""
    return np.frombuffer(prefix_tokens, "<i4")


def batches_of(lengths: Sequence[int], budget: int) -> Iterator[list[int]]:
    """Greedy groups of consecutive documents whose counts stay within a budget (one document at least)."""
    running, group = 0, 0
    marks = []
    for n in lengths:
        if running and running + n > budget:
            group, running = group + 1, 0
        running += n
        marks.append(group)
    for _, members in itertools.groupby(range(len(marks)), key=marks.__getitem__):
        yield list(members)
