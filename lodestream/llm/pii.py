"""Personal data in texts, in built-in expressions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, number ranges for addresses), and words
nearby raise or lower a score that every span carries.  The contract's four base kinds are kept on their validators alone, whatever their score;
the kinds this method adds (IBANs, social-security numbers, account numbers that a word announces) stand or fall with it: an account number or a
social-security number needs a word that speaks for it, an IBAN is given up where the words speak against it.

Matches are leftmost and do not overlap within a kind.  The patterns below find what the plain ones find, written so that matching
takes time in proportion to the text: runs are possessive, and a run is tried from its beginning only.  A text is cut by the same
pattern, so the lengths of gaps and matches give the places in code points.

Defined results: null and empty texts have no spans; very long texts are searched whole; equal texts have equal spans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty

#: Added spans are kept from this score on.
THRESHOLD = 0.5
#: Code points before and after a span in which context words count.
NEAR = 40

_LOCAL = "A-Za-z0-9._%+-"

#: Country codes by the length of their IBANs, those in use outside the registry included.
IBAN_CODES = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV",
    22: "BG BH CR DE GB GE GG IE IM JE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR",
    27: "BI BL CF CG CM DJ FR GA GF GP GQ GR IT KM MC MF MG MQ MR NC PF PM RE SM TD TF WF YT",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}
_IBAN = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{length - 4}}}" for length, codes in IBAN_CODES.items())


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: from the right, every second digit doubled, its digits summed."""
    from_right = F.split(F.reverse(digits), "")
    values = F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an IBAN (upper case, no spaces) leaves 1 modulo 97, its first four characters moved to the end, letters as 10 to 35."""
    moved = F.split(F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4)), "")
    remainder = F.aggregate(moved, F.lit(0), lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))
    return remainder == 1


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``needs`` is a pattern that any text with a match contains; it spares most texts the search.  ``confirm`` looks at the match.
    ``base`` is the score of a confirmed match; ``speaks_for`` is the pattern of the words nearby that raise it by ``LIFT``, ``speaks_against`` of those
    that lower it by ``LIFT``.  Spans of an ``added`` kind are kept from ``THRESHOLD`` on.
    """

    name: str
    pattern: str
    needs: Callable[[Column], Column]
    confirm: Callable[[Column], Column] | None
    base: float
    speaks_for: str
    speaks_against: str = r"(?i)\b(?:example|sample|dummy|fake|test|beispiel|ejemplo|exemple)"
    added: bool = False


#: What one direction of context is worth.
LIFT = 0.35

#: The kinds in the order in which spans are listed.
KINDS = (
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), None, 0.6, r"(?i)\b(?:e-?mail|contact|write|mailto|kontakt|correo|courriel)"),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        lambda t: F.contains(t, F.lit(".")),
        lambda m: ~m.rlike(r"(?:^|\.)0*+(?:[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]|[0-9]{4,})(?:\.|$)"),
        0.5,
        r"(?i)\b(?:ip|host|server|address|login|from)\b",
        r"(?i)\b(?:version|release|build|section|v)\b",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?+[0-9])++",
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
        lambda m: let(_digits(m), lambda d: F.length(d).between(13, 19) & luhn(d)),
        0.6,
        r"(?i)card|visa|credit|debit|karte|tarjeta|carte",
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(9, 15), 0.6, r"(?i)phone|\btel\b|call|mobil|\bfax\b|telefon|llame|appel"),
    Kind(
        "iban",
        rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"),
        lambda m: let(F.replace(m, F.lit(" "), F.lit("")), mod97),
        0.6,
        r"(?i)iban|account|konto|cuenta|compte|bank|\bbic\b",
        added=True,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        lambda m: ~m.rlike("^(?:000|666|9)") & ~F.substring(m, 5, 2).eqNullSafe("00") & ~F.substring(m, 8, 4).eqNullSafe("0000"),
        0.4,
        r"(?i)\bssn\b|social|security|insurance|versicherung|seguro|assur",
        r"(?i)\b(?:example|sample|dummy|fake|test|part|model|serial|order|invoice)",
        added=True,
    ),
    Kind(
        "account",
        r"(?<![A-Za-z0-9.,+-])[0-9](?:[\x20-]?+[0-9]){7,16}+(?![A-Za-z0-9])(?![\x20.,-][0-9])",
        lambda t: t.rlike(r"(?i)\b(?:account|acct|konto|kontonummer|cuenta|compte|routing)\b") & t.rlike(r"[0-9](?:[\x20-]?[0-9]){7}"),
        None,
        0.3,
        r"(?i)\b(?:account|acct|konto|kontonummer|cuenta|compte|routing)\b",
        r"(?i)\b(?:example|sample|dummy|fake|test|order|invoice|isbn|version)",
        added=True,
    ),
)
BASE_KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind:string,start:int,stop:int,score:double,text:string>"


def _places(lengths: Column) -> Column:
    """Running ends of alternating gap and match lengths, by blocks: sums within each block of 64, then over the blocks before it."""
    size = 64

    def block(i: Column) -> Column:
        part = F.slice(lengths, i * size + 1, F.lit(size))
        return F.transform(part, lambda x, k: F.aggregate(F.slice(part, F.lit(1), k + 1), F.lit(0), lambda total, y: total + y))

    def shifted(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.element_at(b, -1))
        before = F.transform(ends, lambda x, k: F.aggregate(F.slice(ends, F.lit(1), k), F.lit(0), lambda total, y: total + y))
        return let(before, lambda w: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x: x + F.get(w, k)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / size).cast("int")), block)
    return let(blocks, shifted)


def spans_of(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind, in order of place."""

    def located(matches: Column, gaps: Column) -> Column:
        def build(lengths: Column) -> Column:
            return let(_places(lengths), lambda ends: F.transform(matches, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("stop"), m.alias("text"))))

        return let(F.zip_with(F.transform(gaps, lambda g: F.length(g)), matches, lambda g, m: g + F.coalesce(F.length(m), F.lit(0))), build)

    def scored(found: Column) -> Column:
        if kind.confirm is not None:
            confirm = kind.confirm
            found = F.filter(found, lambda s: confirm(s["text"]))

        def score(s: Column) -> Column:
            from_ = F.greatest(s["start"] - NEAR, F.lit(0))
            near = F.concat(F.substring(text, from_ + 1, s["start"] - from_), F.lit(" "), F.substring(text, s["stop"] + 1, F.lit(NEAR)))
            return let(near, lambda n: F.lit(kind.base) + F.when(n.rlike(kind.speaks_for), F.lit(LIFT)).otherwise(F.lit(0.0)) - F.when(n.rlike(kind.speaks_against), F.lit(LIFT)).otherwise(F.lit(0.0)))

        out = F.transform(found, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), score(s).alias("score"), s["text"].alias("text")))
        return F.filter(out, lambda s: s["score"] >= THRESHOLD) if kind.added else out

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    searched = let(matches, lambda m: F.when(F.size(m) > 0, scored(located(m, F.split(text, kind.pattern, -1)))))
    return F.coalesce(F.when(kind.needs(text), searched), F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Adds an array of ``(kind, start, stop, score, text)``: by kind as listed in ``KINDS``, then by place; places in code points."""
    if spans_col in docs.columns:
        raise ValueError(f"there is a column {spans_col!r} already")
    text = text_or_empty(text_col)
    return docs.withColumn(spans_col, F.concat(*[spans_of(text, k) for k in KINDS]))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per base kind, the hash of the base spans, all spans, and their scores in hundredths, per document."""
    found = with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")), "_text", "_spans").select("doc_id", "_spans")
    base = F.filter("_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[_number(F.col("_spans"), kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("_spans")).alias("spans"),
        F.array_join(F.transform("_spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"),
        *[_number(F.col("_spans"), k.name).alias(f"n_{k.name}") for k in KINDS if k.added],
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each span of the text replaced by its kind in brackets, as in ``[EMAIL]``.

    Overlapping spans of different kinds are replaced together, under the kind of the one that begins first (the longer of equals).
    Null texts stay null.
    """
    name = "_spans"
    while name in docs.columns:
        name += "_"
    spanned = with_spans(docs, text_col, name)
    text, spans = F.col(text_col), F.col(name)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("minus_stop"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        stop = -s["minus_stop"]
        fresh = s["start"] >= acc["at"]
        added = F.when(fresh, F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], stop).alias("at"), added.alias("parts"))

    cleaned = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return spanned.withColumn(text_col, F.when(F.size(spans) > 0, cleaned).otherwise(text)).select(*docs.columns)
