"""Chunks of source files: sections of markdown, symbols of code, or windows of lines.

The core works on one text and knows nothing of Spark; :func:`chunked` applies it to a table, one Arrow batch at a time.
Lengths count UTF-16 units, as the limits of the stored chunks do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_LINES = 60
OVERLAP = 10
MAX_CHARS = 1500

# Patterns of lines that begin a symbol, by family of languages, in the matching rules of ASCII classes.
FAMILIES = {
    "jvm": r"^\s{0,8}(?:public|private|protected|internal|static|final|abstract|synchronized|sealed|virtual|override|partial|extern|unsafe|inline|export|async|open|operator|suspend|tailrec|infix|@\w+)*\s*(?:class|interface|enum|record|trait|struct|object|protocol|namespace|delegate|event|fun|func|def|function|void|int|long|double|float|boolean|String|char|byte|short|bool|let|val|var|const|typealias|extension|init|deinit)\s+[A-Za-z_][\w\$]*\s*[<({:]",
    "c": r"^(?:(?:static|inline|extern|const|volatile|unsigned|signed|register|virtual|explicit|constexpr|noexcept|template\s*<[^>]*>)\s+)*[A-Za-z_]\w*(?:\s*::\s*[A-Za-z_]\w*)*[ \t]*[\*&]*[ \t]*[A-Za-z_]\w*(?:\s*::~?[A-Za-z_]\w*)?[ \t]*\(",
    "keyword": r"^\s{0,12}(?:async\s+)?(?:def|defp|class|module|defmodule|defmacro|defprotocol|defimpl)\s+[A-Za-z_][\w\.]*",
    "rust": r"^\s{0,8}(?:pub(?:\s*\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:fn|struct|enum|impl|trait|mod|type|const|static|union)\s+[A-Za-z_]",
    "go": r"^(?:func(?:\s*\([^)]*\))?\s+[A-Za-z_]|type\s+[A-Za-z_]|var\s+[A-Za-z_]|const\s+[A-Za-z_])",
    "php": r"^\s{0,8}(?:public|private|protected|static|final|abstract)*\s*(?:function|class|interface|trait|namespace)\s+[A-Za-z_]",
    "lisp": r"^\(\s*(?:defun|defmacro|defmethod|defclass|defparameter|defvar|defconstant|defstruct|defgeneric|defpackage|in-package|define|define-syntax|define-record-type|defmulti|defprotocol|defrecord|deftype|defn|defn-)\s+[A-Za-z_]",
}
# The family of each language that has symbols.
LANGUAGES = {
    "jvm": "java groovy javascript typescript kotlin scala csharp swift dart",
    "c": "c cpp objc",
    "keyword": "python ruby elixir",
    "rust": "rust",
    "go": "go",
    "php": "php",
    "lisp": "lisp scheme racket clojure",
}
# Words that are never the name of a symbol.
KEYWORDS = frozenset(
    """public private protected internal static final abstract synchronized sealed virtual override partial extern unsafe inline export async
    open operator suspend tailrec infix data annotation companion def defp defmodule defmacro defprotocol defimpl class interface enum record
    trait struct union protocol object namespace package module impl fn fun func function let val var const typealias extension init deinit
    async await yield new return this self super using typedef template typename if for while switch case do else try catch finally throw
    throws break continue default delegate event void int long double float boolean bool char byte short String auto noexcept constexpr
    explicit volatile unsigned signed register pub crate where unsafe mut dyn move ref""".split()
)
_STARTS = {language: re.compile(FAMILIES[family], re.ASCII) for family, languages in LANGUAGES.items() for language in languages.split()}
_HEADING = re.compile(r"#{1,2}\s+", re.ASCII)
_NAMED = re.compile(r"([A-Za-z_][\w$]*)\s*[<({:]", re.ASCII)
_WORD = re.compile(r"[\w$]+", re.ASCII)
#: What counts as blank at the ends of a text: all characters up to the space.
_BLANK = "".join(map(chr, range(33)))


class Chunk(NamedTuple):
    start_line: int
    end_line: int
    symbol: str | None
    content: str


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) + sum(c > "￿" for c in text)


def symbol_name(line: str) -> str | None:
    """The name that a declaration's first line gives to its symbol.

    The first word before a bracket or colon that is no keyword, else the last word that could be a name and is none.
    """
    for name in _NAMED.findall(line):
        if name not in KEYWORDS:
            return name
    words = [w for w in _WORD.findall(line) if w not in KEYWORDS and not w[0].isdigit() and w[0] != "$"]
    return words[-1] if words else None


def _char_slices(line: str, limit: int) -> Iterator[str]:
    raw = line.encode("utf-16-le", "surrogatepass")
    for at in range(0, len(raw), 2 * limit):
        yield raw[at : at + 2 * limit].decode("utf-16-le", "replace")


def fitted(lines: list[str], first: int, last: int, symbol: str | None, limit: int = MAX_CHARS) -> Iterator[Chunk]:
    """Lines ``first`` to ``last`` (from 0) as chunks within the limit: halved by lines as often as needed, a long line cut by length.

    Pieces of one line all carry that line's number.
    """
    pending = [(first, last)]
    while pending:
        a, b = pending.pop()
        body = "\n".join(lines[a : b + 1])
        if units(body) <= limit:
            yield Chunk(a + 1, b + 1, symbol, body)
        elif b > a:
            half = a + (b - a + 1) // 2
            pending += [(half, b), (a, half - 1)]
        else:
            yield from (Chunk(a + 1, b + 1, symbol, piece) for piece in _char_slices(body, limit))


def _windows(lines: list[str], symbol: str | None) -> Iterator[tuple[int, int, str | None]]:
    start = 0
    while True:
        stop = min(start + WINDOW_LINES, len(lines))
        yield start, stop - 1, symbol
        if stop == len(lines):
            return
        start = stop - OVERLAP


def _sections(lines: list[str], language: str | None) -> Iterator[tuple[int, int, str | None]]:
    """First line, last line and symbol of the sections that a text falls into."""
    if language == "markdown":
        starts = [(k, re.sub(r"^#+\s+", "", line, flags=re.ASCII).strip(_BLANK)) for k, line in enumerate(lines) if _HEADING.match(line)]
    elif language in _STARTS:
        starts = [(k, symbol_name(line)) for k, line in enumerate(lines) if _STARTS[language].search(line)]
        if starts and starts[0][0] > 0:
            yield 0, starts[0][0] - 1, None
    else:
        starts = []
    if not starts:
        yield from _windows(lines, None)
    for (k, symbol), following in zip(starts, [*(k for k, _ in starts[1:]), len(lines)], strict=False):
        yield k, following - 1, symbol


def chunks(content: str | None, language: str | None) -> list[Chunk]:
    """All chunks of a text in order.  Sections that are blank are left out; so is what precedes a markdown text's first heading."""
    if not content:
        return []
    lines = content.split("\n")
    return [c for a, b, symbol in _sections(lines, language) if "\n".join(lines[a : b + 1]).strip(_BLANK) for c in fitted(lines, a, b, symbol)]


def token_estimate(content: Column) -> Column:
    """A quarter of the UTF-16 length, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(F.encode(content, "UTF-16LE")) / 8).cast("int"))


def chunked(files: DataFrame, *keys: str) -> DataFrame:
    """One row per chunk of ``files`` (columns ``content`` and ``language``): the key columns, then
    ``chunk_no, start_line, end_line, symbol, content, token_est``."""
    own = [files.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, language = batch.column("content"), batch.column("language")
            for row in range(batch.num_rows):
                found = chunks(content[row].as_py(), language[row].as_py())
                if found:
                    at = pa.array([row] * len(found))
                    start, end, symbol, text = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k).take(at) for k in keys], pa.array(range(len(found)), pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(symbol, pa.string()), pa.array(text, pa.string())],
                        names=[*keys, "chunk_no", "start_line", "end_line", "symbol", "content"],
                    )

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in own], "chunk_no int, start_line int, end_line int, symbol string, content string"])
    rows = files.select(*keys, "content", "language") if not {"content", "language"} & set(keys) else files
    return rows.mapInArrow(run, schema).withColumn("token_est", token_estimate(F.col("content")))


def line_windows(content: Column, lines: int = WINDOW_LINES, overlap: int = OVERLAP) -> Column:
    """Window chunks as an expression: an array of ``(start_line, end_line, content)``, blank windows left out, nothing split by length."""
    split = F.split(content, "\n", -1)
    n, step = F.size(split), lines - overlap
    count = F.when(n <= lines, F.lit(1)).otherwise(F.ceil((n - lines) / step).cast("int") + 1)
    made = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda k: F.struct((k * step + 1).alias("start_line"), F.least(k * step + lines, n).alias("end_line"), F.array_join(F.slice(split, k * step + 1, F.lit(lines)), "\n").alias("content")),
    )
    return F.when(F.length(content) > 0, F.filter(made, lambda c: c["content"].rlike(r"[^\x00-\x20]"))).otherwise(F.slice(made, 1, 0))
