"""String functions as column expressions; the two that need characters' properties or pairwise work run on Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Quotation marks of other alphabets and their plain forms.
QUOTES = {"‘": "'", "’": "'", "‛": "'", "❛": "'", "❜": "'", "“": '"', "‟": '"', "”": '"', "❝": '"', "❞": '"', "〝": '"', "〞": '"'}
# The entities that are decoded, in the order in which they are.
ENTITIES = (("&sp;", " "), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))
# Characters whose plain form is not what is left without their accents.
PLAIN = {
    "’": "'", "‘": "'", "‛": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "«": "<<", "»": ">>", "—": "-", "–": "-", "−": "-",
    "ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "©": "(c)", "®": "(r)", "€": "EUR", "£": "GBP", "¥": "JPY", "™": "TM",
    "¶": "P", "§": "S", "°": "o", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D",
}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def substring(s, start: int, n: int) -> Column:
    """``n`` characters from ``start``, counted from 0."""
    return F.substring(_c(s), start + 1, n)


def take(s, n: int) -> Column:
    """The first ``n`` characters, or the last ``-n``, padded with spaces on the other side to that length."""
    if n >= 0:
        return F.rpad(_c(s), n, " ")
    return F.when(F.length(_c(s)) >= -n, F.right(_c(s), F.lit(-n))).otherwise(F.lpad(_c(s), -n, " "))


def drop(s, n: int) -> Column:
    """Without the first ``n`` characters, or without the last ``-n``; empty if there are no more."""
    if n >= 0:
        return F.substring(_c(s), n + 1, 2_000_000_000)
    return F.left(_c(s), F.greatest(F.length(_c(s)) + n, F.lit(0)))


def right_strip(s) -> Column:
    return F.regexp_replace(_c(s), r"\s+$", "")


def left_strip(s) -> Column:
    return F.regexp_replace(_c(s), r"^\s+", "")


def strip(s) -> Column:
    """Without control characters and spaces at either end."""
    return F.regexp_replace(_c(s), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def join(parts: Column, separator: str) -> Column:
    """Elements of an array with a separator between them, which is left out while nothing precedes it."""
    return F.aggregate(parts, F.lit(""), lambda acc, x: F.when(acc == "", x).otherwise(F.concat(acc, F.lit(separator), x)))


def is_empty(s) -> Column:
    return _c(s).isNull() | (_c(s) == "")


def first_char(s) -> Column:
    return F.nullif(F.substring(_c(s), 1, 1), F.lit(""))


def split(s, pattern: str) -> Column:
    """Parts between matches, without empty ones at the end; none for null or empty text."""
    parts = F.split(_c(s), pattern, -1)
    last = F.aggregate(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.when(is_empty(s), F.array().cast("array<string>")).otherwise(F.slice(parts, F.lit(1), last))


def printf(pattern: str, *values) -> Column:
    """Values in a pattern of ``%`` fields, as the JVM formats them."""
    return F.format_string(pattern, *[v if isinstance(v, Column) else F.col(v) for v in values])


def could_be_binary(text) -> Column:
    """Whether a text can be Base64: only its alphabet, in whole groups of four."""
    t = F.regexp_replace(text if isinstance(text, Column) else F.col(text), r"[\r\n]", "")
    return F.coalesce(t.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(t) % 4 == 0) & (F.length(t) > 0), F.lit(False))


def html_to_text(s) -> Column:
    """Line breaks for ``<br>``, a space for any other tag, plain quotation marks, decoded entities; null as empty."""
    text = F.regexp_replace(F.coalesce(_c(s), F.lit("")), "<br *[^>]*>", "\n")
    text = F.translate(text, "".join(QUOTES), "".join(QUOTES.values()))
    text = F.regexp_replace(text, "<[^>]*>", " ")
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, text)


@F.pandas_udf(StringType())
def _without_marks(s: pd.Series) -> pd.Series:
    def plain(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        return "".join(c for c in unicodedata.normalize("NFD", text) if c < "\x80" and unicodedata.category(c)[0] != "M")

    return s.map(plain, na_action="ignore")


def to_ascii(s) -> Column:
    """Plain letters: accents off, special characters spelled out, anything else left out."""
    text = _c(s)
    single = {k: v for k, v in PLAIN.items() if len(v) == 1}
    text = F.translate(text, "".join(single), "".join(single.values()))
    for character, plain in PLAIN.items():
        if len(plain) > 1:
            text = F.replace(text, F.lit(character), F.lit(plain))
    return _without_marks(text)


def similarity(one: str, two: str) -> float:
    """Jaro similarity of two texts, raised for a common beginning of any length when it is at least 0.7.

    The raise per character is a tenth, or one part of the longer text's length if that is less.
    """
    if one == two:
        return 1.0
    short, long = (one, two) if len(one) <= len(two) else (two, one)
    reach = max(len(long) // 2 - 1, 0)
    taken: set[int] = set()
    from_short = []
    for i, c in enumerate(short):
        at = next((j for j in range(max(i - reach, 0), min(i + reach + 1, len(long))) if j not in taken and long[j] == c), None)
        if at is not None:
            taken.add(at)
            from_short.append(c)
    m = len(from_short)
    if not m:
        return 0.0
    moved = sum(a != long[j] for a, j in zip(from_short, sorted(taken), strict=True)) // 2
    jaro = (m / len(one) + m / len(two) + (m - moved) / m) / 3
    if jaro < 0.7:
        return jaro
    prefix = next((k for k, (a, b) in enumerate(zip(short, long, strict=False)) if a != b), len(short))
    return jaro + min(0.1, 1 / len(long)) * prefix * (1 - jaro)


def closest_match(s, candidates: Sequence[str]) -> Column:
    """The candidate most similar to the text, without spaces and case; the first of equals."""
    squeezed = ["".join(c.split()).lower() for c in candidates]

    @F.pandas_udf(StringType())
    def pick(texts: pd.Series) -> pd.Series:
        def best(text: str | None) -> str | None:
            if text is None or not candidates:
                return None
            own = "".join(text.split()).lower()
            scores = [similarity(own, c) for c in squeezed]
            return candidates[scores.index(max(scores))]

        return texts.map(best, na_action="ignore")

    return pick(_c(s))


# --- codecs


def base64_encode(value) -> Column:
    return F.regexp_replace(F.base64(_c(value)), r"\s", "")


def base64_decode(s) -> Column:
    return F.unbase64(_c(s))


def might_be_base64(s) -> Column:
    return (F.length(_c(s)) % 4 == 0) & _c(s).rlike(r"^[A-Za-z0-9+/]*={0,2}$")


def url_with(base: str, parameters: dict[str, Column]) -> Column:
    """A URL with encoded parameters."""
    parts = [x for k, (name, value) in enumerate(parameters.items()) for x in (F.lit(("?" if k == 0 else "&") + name + "="), F.url_encode(value.cast("string")))]
    return F.concat(F.lit(base), *parts)


def xml_escape(s) -> Column:
    # The five entities of XML; the ampersand first.
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")), _c(s))


def xml_unescape(s) -> Column:
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")), _c(s))


def encrypt(value, password: str) -> Column:
    """AES with a key that is derived from a password by SHA-256; the nonce is drawn for each value and kept with it."""
    return base64_encode(F.aes_encrypt(_c(value), F.unhex(F.sha2(F.lit(password), 256))))


def decrypt(value, password: str) -> Column:
    return F.aes_decrypt(base64_decode(value), F.unhex(F.sha2(F.lit(password), 256))).cast("string")
