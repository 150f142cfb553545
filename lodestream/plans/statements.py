"""INSERT, UPDATE and DELETE over versioned tables: a statement becomes a query over the table's rows, whose result is the next version."""

from __future__ import annotations

import re
from typing import NamedTuple


class Statement(NamedTuple):
    """``kind`` is insert, update or delete; ``columns`` are those inserted or set, ``values`` the expressions they are set to."""

    kind: str
    table: str
    columns: tuple[str, ...]
    values: tuple[str, ...]
    source: str
    condition: str


_NAME = r"`?([A-Za-z_][A-Za-z_0-9.]*)`?"
_INSERT = re.compile(rf"\s*INSERT\s+INTO\s+{_NAME}\s*(?:\(([^()]*)\)\s*)?((?:VALUES|SELECT|WITH)\b.*)", re.I | re.S)
_UPDATE = re.compile(rf"\s*UPDATE\s+{_NAME}\s+SET\s+(.*)", re.I | re.S)
_DELETE = re.compile(rf"\s*DELETE\s+FROM\s+{_NAME}\s*(.*)", re.I | re.S)


def pieces(text: str, stop: str | None = None, separator: str | None = None) -> list[str]:
    """Cut a text at a separator, or once before a keyword, where it stands outside quotes and parentheses."""
    out, begun, depth, at = [], 0, 0, 0
    while at < len(text):
        c = text[at]
        if c in "'\"`":
            end = text.find(c, at + 1)
            at = len(text) if end < 0 else end + 1
            continue
        depth += (c == "(") - (c == ")")
        if depth == 0 and separator and c == separator:
            out.append(text[begun:at])
            begun = at + 1
        elif depth == 0 and stop and (at == 0 or not text[at - 1].isalnum()) and re.match(rf"{stop}\b", text[at:], re.I):
            return [text[:at], text[at + len(stop) :]]
        at += 1
    return [*out, text[begun:]]


def parse(text: str) -> Statement:
    text = text.strip().rstrip(";")
    if m := _INSERT.fullmatch(text):
        columns = tuple(c.strip(" `\n\t").lower() for c in (m[2] or "").split(",") if c.strip())
        return Statement("insert", m[1].lower(), columns, (), m[3], "")
    if m := _UPDATE.fullmatch(text):
        assigned, *rest = pieces(m[2], stop="WHERE")
        pairs = [pieces(p, separator="=") for p in pieces(assigned, separator=",")]
        if any(len(p) < 2 for p in pairs):
            raise ValueError(f"not an assignment in {assigned!r}")
        return Statement("update", m[1].lower(), tuple(p[0].strip(" `\n\t").lower() for p in pairs), tuple("=".join(p[1:]).strip() for p in pairs), "", (rest or [""])[0].strip())
    if m := _DELETE.fullmatch(text):
        before, *rest = pieces(m[2], stop="WHERE")
        if before.strip():
            raise ValueError(f"what is {before.strip()!r} in a DELETE?")
        return Statement("delete", m[1].lower(), (), (), "", (rest or [""])[0].strip())
    raise ValueError(f"neither INSERT, UPDATE nor DELETE: {text[:60]!r}")
