"""Number functions as column expressions, and number pictures on Arrow batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def near(a, b, eps: float) -> Column:
    return F.abs(_c(a) - _c(b)) < eps


def round_half_up(n, places: int) -> Column:
    """Halves away from zero, in doubles."""
    r = F.lit(10.0**places)
    return F.signum(_c(n)) * F.floor(F.abs(_c(n) * r) + 0.5) / r


def round_up(n, places: int) -> Column:
    """Away from zero."""
    r = F.lit(10.0**places)
    return F.signum(_c(n)) * F.ceil(F.abs(_c(n) * r)) / r


def round_down(n, places: int) -> Column:
    """Toward zero."""
    r = F.lit(10.0**places)
    return F.signum(_c(n)) * F.floor(F.abs(_c(n) * r)) / r


def floor(n) -> Column:
    return F.floor(_c(n))


def parse_double(s) -> Column:
    """The number at the beginning of a text, with thousands separators; 0 if there is none."""
    head = F.regexp_extract(_c(s), r"^-?[0-9][0-9,]*(?:\.[0-9]*)?|^-?\.[0-9]+", 0)
    return F.coalesce(F.replace(head, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def parse_long(s) -> Column:
    return F.coalesce(parse_double(s).try_cast("long"), F.lit(0).cast("long"))


def parse_int(s) -> Column:
    return F.coalesce(parse_double(s).try_cast("int"), F.lit(0))


def is_number(s) -> Column:
    """Digits and commas with at most one dot."""
    return F.coalesce(_c(s).rlike(r"^[0-9,]*\.?[0-9,]*$") & _c(s).rlike("[0-9]"), F.lit(False))


def _digits(whole: int, base: int) -> str:
    out = ""
    while whole:
        whole, digit = divmod(whole, base)
        out = DIGITS[digit] + out
    return out


def picture(number: float | None, mask: str = "", width: int = 0, places: int = -1, base: int = 10) -> str | None:
    """A number by a picture: ``B`` blank if zero, ``C`` commas, ``L`` left-justified, ``P`` parentheses if negative, ``Z`` zero-filled, ``D`` a
    dollar sign, ``U`` capital digits, ``R`` a per-cent sign.

    Width 0 means as wide as need be; negative places mean as many as the number has.  What does not fit gives up its leading zero, the
    dollar sign, the commas, the parentheses and the per-cent sign, in this order, and is all asterisks in the end.
    """
    if number is None or math.isnan(number):
        return None
    if not 2 <= base <= len(DIGITS):
        base = 10
    negative, size = number < 0, abs(number)
    if places < 0:
        places, rest = 0, size - math.floor(size)
        while places < 20 and rest > 1e-5:
            places += 1
            rest = math.floor(rest * base * 1e5 + 0.5) / 1e5
            rest -= math.floor(rest)
    units = math.floor(size * base**places + 0.5)
    if "B" in mask and units == 0:
        return " " * max(width, 1)
    text = _digits(units, base).rjust(places, "0") if places else _digits(units, base)
    whole, part = (text[:-places], text[-places:]) if places else (text, "")
    if "U" in mask:
        whole, part = whole.upper(), part.upper()
    group = 4 if base in (2, 16) else 3
    commas = ",".join([whole[max(0, k - group) : k] for k in range(len(whole), 0, -group)][::-1]) if "C" in mask else whole
    lead, dollar, paren, percent = "" if whole else "0", "$" if "D" in mask else "", "P" in mask, "%" if "R" in mask else ""

    def needed() -> int:
        return len(lead + dollar + commas + percent) + (len(part) + 1 if places else 0) + negative + paren

    if width > 0:
        if needed() > width:
            lead = ""
        if needed() > width:
            dollar = ""
        if needed() > width:
            commas = whole
        if needed() > width:
            paren = False
        if needed() > width:
            percent = ""
        if needed() > width:
            return "*" * width
    body = lead + commas + ("." + part if places else "")
    tail = percent + ((")" if negative else " ") if paren else "")
    sign = ("(" if paren else "-") if negative else ""
    if "Z" in mask and width > 0 and "L" not in mask:
        body = body.rjust(width - len(tail) - len(dollar) - len(sign), "0")
    made = sign + dollar + body + tail
    return made.ljust(width) if "L" in mask else made.rjust(width)


def format_picture(n, mask: str = "", width: int = 0, places: int = -1, base: int = 10) -> Column:
    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else picture(float(v), mask, width, places, base) for v in values], dtype=object)

    return run(_c(n).cast("double"))


def picture_for_proportional_type(number: float | None, mask: str = "", width: int = 0, places: int = -1) -> str | None:
    """A picture for type in which spaces are half as wide as digits: spaces doubled, and one more for each comma in front."""
    text = picture(number, mask, width, places)
    if text is None or "L" in mask or width <= 0:
        return text
    return " " * text.count(",") + text.replace(" ", "  ")
