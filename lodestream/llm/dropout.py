"""Piece segmentation with seeded merge-dropout, and lossless decoding.

Merges are taken from an agenda, best-scored pair first and leftmost of equals, as the plain encoding does; but each candidate that comes up is
skipped when a keyed hash of its place and piece falls under the dropout rate.  Seeds give varied segmentations of the same text, all of
them sequences of vocabulary pieces, and the same seed gives the same one anywhere.  A rate of zero gives the plain encoding.

Every occurrence of a word draws for itself: its key is a hash of the seed, the text and its place there.  What follows from the draws is
remembered, not the draws: a tree of decisions for each word, in which a node is a candidate, its branches are "merged" and "skipped", and a leaf
holds the pieces.  All occurrences walk their trees at once; only where a branch was never taken is the word segmented.
The agendas of many words are processed at once: a matrix holds each word's candidates by rank and each step pops the best of every word.

The piece mark, where it stands in a text itself, is written as its bytes, so it is not mistaken for a space: decoding returns every text
exactly.  Defined results: null and empty texts have no pieces; characters outside the vocabulary become their bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_values
from .pieces import CUT, MARK, Pieces, load, segments

RATE = 0.1
#: Longest segment, in characters, that goes through the matrix and is remembered; longer ones have an agenda of their own.
WIDE = 24
#: Misses from this number on are first thinned to one for each branch.
THIN = 1_000
#: The rank of no merge.
_NONE = np.int32(1 << 30)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64 bits."""
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return x ^ (x >> np.uint64(31))


def _mixed_one(x: int) -> int:
    """The same for one Python integer."""
    x &= _ALL
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _ALL
    return x ^ x >> 31


_ALL = (1 << 64) - 1


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or one of twice the size with the same beginning, so that ``size`` entries fit."""
    if size <= len(array):
        return array
    out = np.zeros(max(2 * len(array), size), array.dtype)
    out[: len(array)] = array
    return out


class DropoutEncoder:
    #: Keys of occurrences are below this.
    variants = 1 << 63

    def __init__(self, path: str, rate: float = RATE, seed: int = 1, cache_size: int = 400_000, node_size: int = 4_000_000):
        self.pieces: Pieces = load(path)
        self.rate, self.cache_size, self.node_size = rate, cache_size, node_size
        self.limit = min(int(rate * 2.0**64), 2**64 - 1)
        self.seed = str(seed).encode()
        self._tables()
        self._clear()

    def _clear(self) -> None:
        """Forget every word and tree."""
        #: Number of a word; its parts are ``parts[first[word]:][:number[word]]``, each the slot of a tree's root.
        self.words: dict[str, int] = {}
        self.first, self.number, self.parts = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.n_words = self.n_parts = 0
        self.roots: dict[str, int] = {}
        self.text_at: dict[int, str] = {}
        #: What stands at a slot: a node, a leaf as a negative number, or 0 where nobody went.  Node k has the slots 2k (merged) and 2k + 1 (skipped).
        self.next, self.code, self.n_nodes = np.zeros(1 << 14, np.int32), np.zeros(1 << 13, np.uint64), 1
        self.leaf_start, self.leaf_size, self.n_leaves = np.zeros(1 << 13, np.int64), np.zeros(1 << 13, np.int64), 1
        self.leaf_ids, self.n_ids = np.zeros(1 << 15, np.int32), 0

    def _nodes(self, n: int) -> np.ndarray:
        """The numbers of ``n`` new nodes."""
        out = np.arange(self.n_nodes, self.n_nodes + n)
        self.n_nodes += n
        self.code, self.next = _room(self.code, self.n_nodes), _room(self.next, 2 * self.n_nodes)
        return out

    def _leaves(self, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The numbers of new leaves, whose ids follow one another."""
        out = np.arange(self.n_leaves, self.n_leaves + len(sizes))
        self.n_leaves += len(sizes)
        self.leaf_start, self.leaf_size = _room(self.leaf_start, self.n_leaves), _room(self.leaf_size, self.n_leaves)
        self.leaf_start[out], self.leaf_size[out] = self.n_ids + np.cumsum(sizes) - sizes, sizes
        self.leaf_ids = _room(self.leaf_ids, self.n_ids + len(ids))
        self.leaf_ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        return out

    def _plant(self, parts: list[str]) -> list[int]:
        """The slots of the roots of parts."""
        roots = self.roots
        new = [p for p in dict.fromkeys(parts) if p not in roots]
        slots = (2 * self._nodes(len(new))).tolist()
        roots.update(zip(new, slots, strict=True))
        self.text_at.update(zip(slots, new, strict=True))
        if "" in new:  # a mark of the text itself
            ids = np.array([self.pieces.byte_id[b] for b in MARK.encode()], np.int32)
            self.next[roots[""]] = -self._leaves(np.array([len(ids)]), ids)[0]
        return list(map(roots.__getitem__, parts))

    def _tables(self) -> None:
        """Every pair of pieces whose merge is a piece, as a sorted array of codes."""
        ids, rank = self.pieces.id, self.pieces.rank
        if max(ids.values(), default=0) >= 1 << 16:
            raise ValueError("pairs are kept in 32 bits: a vocabulary of over 65,536 pieces needs wider codes")
        found = [(ids[a] << 16 | ids[b], ids[p], rank[p]) for p in ids for k in range(1, len(p)) if (a := p[:k]) in ids and (b := p[k:]) in ids]
        found.sort()
        codes, made, ranks = zip(*found, strict=True)
        self.made, self.ranks = np.array([*made, -1], np.int32), np.array([*ranks, _NONE], np.int32)
        # open addressing keyed by the pair
        bits = max(20, (2 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        codes = np.array(codes, np.uint64)
        self.slot_code = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.slot_at = np.full(1 << bits, len(codes), np.int32)
        pending, place = np.arange(len(codes)), self._hash(codes)
        while len(pending):
            free = self.slot_code[place] == np.iinfo(np.uint64).max
            first = np.unique(place[free], return_index=True)[1]
            taken = np.flatnonzero(free)[first]
            self.slot_code[place[taken]] = codes[pending[taken]]
            self.slot_at[place[taken]] = pending[taken]
            left = np.ones(len(pending), bool)
            left[taken] = False
            pending, place = pending[left], (place[left] + 1) & self.mask

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of the merge of each pair, or that of no merge."""
        none = len(self.ranks) - 1
        out = np.full(len(left), none, np.int32)
        known = np.flatnonzero((left >= 0) & (right >= 0))
        codes = (left[known].astype(np.uint64) << np.uint64(16)) | right[known].astype(np.uint64)
        place = self._hash(codes)
        while len(known):
            held = self.slot_code[place]
            hit = held == codes
            out[known[hit]] = self.slot_at[place[hit]]
            go = ~hit & (held != np.iinfo(np.uint64).max)
            known, codes, place = known[go], codes[go], (place[go] + 1) & self.mask
        return out

    def _many(self, words: list[str], keys: np.ndarray) -> list[bytes]:
        """The ids of short words, one key each."""
        at = np.array(self._plant(words))
        keys = keys.astype(np.uint64)
        self._grow(words, at, keys)
        leaves = self._walk(at, keys)[1].tolist()
        return [self.leaf_ids[(start := self.leaf_start[k]) : start + self.leaf_size[k]].astype("<i4").tobytes() for k in leaves]

    def _walk(self, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last known slot from each slot on, and the leaf there or 0."""
        slots, leaves = at.copy(), np.zeros(len(at), np.int64)
        limit = np.uint64(self.limit)
        for start in range(0, len(at), 1 << 16):
            rows = np.arange(start, min(start + (1 << 16), len(at)))
            own, slot = keys[rows], at[rows]
            while True:
                found = self.next[slot]
                ends = np.flatnonzero(found <= 0)
                slots[rows[ends]], leaves[rows[ends]] = slot[ends], -found[ends]
                on = np.flatnonzero(found > 0)
                if not len(on):
                    break
                rows, own, node = rows[on], own[on], found[on].astype(np.int64)
                slot = 2 * node + (_mixed(own + self.code[node]) < limit)
        return slots, leaves

    def _grow(self, words: list[str], slot: np.ndarray, keys: np.ndarray) -> None:
        """Segment short words, whose agendas are processed together, and add to their trees, from the roots on, the branches that they take."""
        slot = slot.copy()
        limit = np.uint64(self.limit)
        ids = self.pieces.id
        n, width = len(words), max(map(len, words))
        lengths = np.fromiter(map(len, words), np.int64, n)
        joined = "".join(words)
        flat = np.fromiter(map(ids.get, joined, [-1] * len(joined)), np.int32, len(joined))
        symbol = np.full((n, width + 1), -1, np.int32)
        symbol[:, :width][np.arange(width) < lengths[:, None]] = flat
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        alive = np.arange(width + 1) < lengths[:, None]
        after[np.arange(n), np.maximum(lengths - 1, 0)] = width  # the spare column ends every word
        merge = self._lookup(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width)
        agenda = self.ranks[merge]
        rows = np.arange(n)
        while len(rows):
            best = agenda[rows].argmin(axis=1)
            going = agenda[rows, best] < _NONE
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            made = self.made[merge[rows, best]]
            code = (best.astype(np.uint64) << np.uint64(32)) + made.astype(np.uint64)
            skipped = _mixed(keys[rows] + code) < limit
            here = slot[rows]
            fresh = np.flatnonzero(self.next[here] == 0)
            if len(fresh):
                distinct, first = np.unique(here[fresh], return_index=True)
                nodes = self._nodes(len(distinct))
                self.code[nodes], self.next[distinct] = code[fresh[first]], nodes
            slot[rows] = 2 * self.next[here].astype(np.int64) + skipped
            agenda[rows[skipped], best[skipped]] = _NONE
            act, at, new = rows[~skipped], best[~skipped], made[~skipped]
            gone = after[act, at]
            following = after[act, gone]
            symbol[act, at] = new
            alive[act, gone] = False
            agenda[act, np.minimum(gone, width - 1)] = np.where(gone < width, _NONE, agenda[act, np.minimum(gone, width - 1)])
            after[act, at] = following
            inner = following < width
            before[act[inner], following[inner]] = at[inner]
            # the pairs on either side are new candidates
            right = self._lookup(new, np.where(inner, symbol[act, following], -1))
            merge[act, at], agenda[act, at] = right, self.ranks[right]
            has = before[act, at] >= 0
            prior, held = before[act, at][has], act[has]
            left = self._lookup(symbol[held, prior], new[has])
            merge[held, prior], agenda[held, prior] = left, self.ranks[left]
        fresh = np.flatnonzero(self.next[slot] == 0)
        distinct, first = np.unique(slot[fresh], return_index=True)
        fresh = fresh[first]
        symbol, alive = symbol[fresh, :width], alive[fresh, :width]
        unknown = ((symbol < 0) & alive).any(axis=1)
        plain = np.flatnonzero(~unknown)
        self.next[distinct[plain]] = -self._leaves(alive[plain].sum(axis=1), symbol[plain][alive[plain]])
        for k in np.flatnonzero(unknown).tolist():
            word = words[fresh[k]]
            found = [i for p in np.flatnonzero(alive[k]) for i in ([int(symbol[k, p])] if symbol[k, p] >= 0 else self.pieces.ids_of(word[p]))]
            self.next[distinct[k]] = -self._leaves(np.array([len(found)]), np.array(found, np.int32))[0]

    def _one(self, word: str, key: int) -> bytes:
        """The ids of a long segment: a heap instead of the matrix, the same order and the same hash."""
        ids, rank = self.pieces.id, self.pieces.rank
        symbols, after, before = list(word), [*range(1, len(word)), -1], [-1, *range(len(word) - 1)]
        agenda = [(r, i, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get(a + b)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, merged = heapq.heappop(agenda)
            j = after[i]
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != merged:
                continue
            if self.limit and _mixed_one(key + (i << 32) + ids[merged]) < self.limit:
                continue
            symbols[i], symbols[j] = merged, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(x := merged + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, x))
            if (h := before[i]) >= 0 and (r := rank.get(x := symbols[h] + merged)) is not None:
                heapq.heappush(agenda, (r, h, x))
        return np.array([i for s in symbols if s for i in self.pieces.ids_of(s)], "<i4").tobytes()

    def _words(self, text: str) -> list[str]:
        """The independent parts of a text; a mark of the text itself goes alone, as the empty string."""
        if MARK not in text:
            return segments(text)
        out: list[str] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append("")
            if k == 0:
                out += segments(part) or [MARK]
            elif part:
                # what follows a mark of the text begins without the mark in front
                head, *rest = segments(part)
                out += [head[1:], *rest] if len(head) > 1 else rest
        return [w for k, w in enumerate(out) if w or k]

    def _learn(self, words: list[str]) -> None:
        """Number new words, which are whole where nothing cuts them."""
        split = [[w] if not w or w[1:].isalpha() else CUT.split(w) for w in words]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        parts = self._plant(list(itertools.chain.from_iterable(split)))
        start, self.n_words = self.n_words, self.n_words + len(words)
        self.words.update(zip(words, range(start, self.n_words), strict=True))
        self.first, self.number = _room(self.first, self.n_words), _room(self.number, self.n_words)
        self.first[start : self.n_words], self.number[start : self.n_words] = self.n_parts + np.cumsum(sizes) - sizes, sizes
        self.parts = _room(self.parts, self.n_parts + len(parts))
        self.parts[self.n_parts : self.n_parts + len(parts)] = parts
        self.n_parts += len(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.words) > self.cache_size or self.n_nodes > self.node_size:
            self._clear()
        split = [self._words(t) for t in texts]
        words = list(itertools.chain.from_iterable(split))
        if not words:
            return [b""] * len(texts)
        numbers = np.fromiter(map(self.words.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(words[k] for k in new)))
            numbers[new] = [self.words[words[k]] for k in new]
        # the parts of all texts in a row, each with a key of the seed, the text and its place
        sizes = self.number[numbers]
        ends = np.cumsum(sizes)
        roots = self.parts[np.repeat(self.first[numbers] - (ends - sizes), sizes) + np.arange(ends[-1])]
        text_ends = np.concatenate([[0], ends])[np.cumsum([len(x) for x in split])]
        text_sizes = np.diff(text_ends, prepend=0)
        hashes = np.array([int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8, key=self.seed).digest(), "big") for t in texts], np.uint64)
        place = (np.arange(ends[-1]) - np.repeat(text_ends - text_sizes, text_sizes)).astype(np.uint64)
        keys = _mixed(np.repeat(hashes, text_sizes) + place * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
        leaves, kept = self._segmented(roots, keys)
        # the ids of the leaves in a row
        sizes = self.leaf_size[leaves]
        ends = np.cumsum(sizes)
        ids = self.leaf_ids[np.repeat(self.leaf_start[leaves] - (ends - sizes), sizes) + np.arange(ends[-1])].astype("<i4").tobytes()
        self.n_leaves, self.n_ids = kept
        for word in [w for w in (words[k] for k in new) if len(w) > WIDE]:
            if self.words.pop(word, None) is not None:
                for part in [word, *CUT.split(word)]:
                    if len(part) > WIDE and (root := self.roots.pop(part, None)) is not None:
                        del self.text_at[root]
        cuts = [0, *(4 * np.concatenate([[0], ends])[text_ends]).tolist()]
        return [ids[a:b] for a, b in itertools.pairwise(cuts)]

    def _segmented(self, roots: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
        """The leaf of every part, and the numbers of leaves and of ids to keep: those of long parts, made last, serve one occurrence."""
        slots, leaves = self._walk(roots, keys)
        missed = np.flatnonzero(leaves == 0)
        texts = dict.fromkeys(roots[missed].tolist())
        wide = np.array([r for r in texts if len(self.text_at[r]) > WIDE], np.int64)
        is_long = np.isin(roots[missed], wide)
        long, missed = missed[is_long], missed[~is_long]
        while len(missed):
            some = missed[np.unique(slots[missed], return_index=True)[1]] if len(missed) > THIN else missed
            own = [self.text_at[r] for r in roots[some].tolist()]
            # words of alike length share a matrix
            order = np.argsort(np.fromiter(map(len, own), np.int64, len(own)), kind="stable")
            for start in range(0, len(order), 20_000):
                group = order[start : start + 20_000]
                self._grow([own[k] for k in group.tolist()], roots[some[group]], keys[some[group]])
            slots[missed], leaves[missed] = self._walk(slots[missed], keys[missed])
            missed = missed[leaves[missed] == 0]
        kept = self.n_leaves, self.n_ids
        for k in long.tolist():
            ids = np.frombuffer(self._one(self.text_at[int(roots[k])], int(keys[k])), "<i4")
            leaves[k] = self._leaves(np.array([len(ids)]), ids)[0]
        return leaves, kept

    def decode(self, ids: bytes) -> str:
        """The text of a sequence of ids, whatever its segmentation."""
        return b"".join(map(self.pieces.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))[1:].decode()


_encoders: dict[tuple, DropoutEncoder] = {}


def encoder(path: str, rate: float, seed: int) -> DropoutEncoder:
    """One encoder per Python worker and setting."""
    key = (path, rate, seed)
    if key not in _encoders:
        _encoders[key] = DropoutEncoder(path, rate, seed)
    return _encoders[key]


def encoded(docs: DataFrame, model_path: str, rate: float = RATE, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, check: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32``: the number of pieces of each text and the hash of their ids as little-endian 32-bit integers.

    With ``with_ids`` also ``ids``, those integers; with ``check`` also ``lossless``, whether decoding them gives the text again.
    """
    names = ["doc_id", "n_tokens", "ids_crc32", *["ids"] * with_ids, *["lossless"] * check]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path, rate, seed)
        for batch in batches:
            for rows in slices(batch, "text"):
                texts = text_values(rows.column("text"))
                ids = own.encode(texts)
                columns = [rows.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(zlib.crc32, ids)), pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                if check:
                    columns.append(pa.array([own.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    selected = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return selected.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids + ", lossless boolean" * check)


def decoded(sequences: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of sequences of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path, 0.0, 0)
        for batch in batches:
            for rows in slices(batch, "ids"):
                texts = [own.decode(x or b"") for x in rows.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return sequences.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
