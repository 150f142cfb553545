"""A merge-type piece vocabulary (with byte fallback) as plain tables, for the operators that work on its merges.

The vocabulary is read from a model file through its library; scores order the merges: the best-scored pair merges first, the
leftmost of equals.  White space is the piece mark U+2581.  No piece holds that mark behind another character, so a text can be cut in
front of every mark that follows another character: merges never cross such a cut.
"""

from __future__ import annotations

import heapq
import re

#: The character that stands for a space in pieces (a fixed value of the format).
MARK = "▁"
#: Places inside segments where no piece goes on: between a letter and a punctuation mark, and around line ends.
CUT = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,!|:;?])|(?<=\n)(?!$)|(?<!^)(?=\n)")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str] = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(self.text))]
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(len(self.text)) if model.is_byte(i)}
        self.id: dict[str, int] = {p: i for i, p in enumerate(self.text) if not special[i]}
        order = sorted({-model.get_score(i) for i in self.id.values()})
        place = {s: r for r, s in enumerate(order)}
        #: Smaller merges first; pieces of equal score share a rank.
        self.rank: dict[str, int] = {p: place[-model.get_score(i)] for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("this vocabulary has pieces that go across white space")
        if any(len(CUT.split(p)) > 1 for p in self.id):
            raise ValueError("this vocabulary has pieces that go across the cuts")
        self.bytes: list[bytes] = [p.replace(MARK, " ").encode() for p in self.text]
        for value, i in self.byte_id.items():
            self.bytes[i] = bytes([value])

    def merge(self, segment: str) -> list[str]:
        """The pieces of one segment: an agenda of adjacent pairs, best rank first, leftmost of equals."""
        symbols = list(segment)
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        rank = self.rank
        agenda = [(r, i, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get(a + b)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, merged = heapq.heappop(agenda)
            j = after[i]
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != merged:
                continue
            symbols[i], symbols[j] = merged, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(x := merged + symbols[k])) is not None:
                    heapq.heappush(agenda, (r, i, x))
            if (h := before[i]) >= 0 and (r := rank.get(x := symbols[h] + merged)) is not None:
                heapq.heappush(agenda, (r, h, x))
        return [s for s in symbols if s]

    def ids_of(self, symbol: str) -> list[int]:
        """The id of a piece, or the ids of its bytes where the vocabulary lacks it."""
        i = self.id.get(symbol)
        return [i] if i is not None else [self.byte_id[b] for b in symbol.encode()]


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """One vocabulary per Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def segments(text: str) -> list[str]:
    """Cut a text, with the mark put in front, into segments whose merges are independent.  The empty text has none.

    Each segment is one or more marks with the characters up to the next space.
    """
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    parts = (" " + text).split(" ")  # the first is empty: it stands before the mark that is put in front
    if "" not in parts[1:]:
        return [MARK + p for p in parts[1:]]
    out, held = [], 0
    for p in parts[1:]:
        held += 1
        if p:
            out.append(MARK * held + p)
            held = 0
    if held:
        out.append(MARK * held)
    return out
