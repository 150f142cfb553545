"""JSON by dotted paths and by pointers, and templates; parsing and lookup stay in the JVM."""

from __future__ import annotations

import re
import urllib.parse

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse_date

_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def json_path(path: str) -> str:
    """``a.b[0].c`` as a JSON path; an empty path is the whole."""
    out, at = "$", 0
    for m in _STEP.finditer(path):
        if path[at : m.start()] not in ("", "."):
            raise ValueError(f"no path: {path!r}")
        out += f"[{m[2]}]" if m[2] else f"['{_quoted(m[1])}']"
        at = m.end()
    if path[at:] != "":
        raise ValueError(f"no path: {path!r}")
    return out


def _quoted(name: str) -> str:
    if "'" in name or "\\" in name:
        raise ValueError(f"a name that a path cannot hold: {name!r}")
    return name


def get(text, path: str, kind: str = "string") -> Column:
    """The value at a path as a type; null where anything is missing or does not fit."""
    return F.try_variant_get(F.try_parse_json(_c(text)), json_path(path), kind)


def get_string(text, path: str) -> Column:
    return get(text, path)


def get_int(text, path: str) -> Column:
    return get(text, path, "int")


def get_long(text, path: str) -> Column:
    return get(text, path, "bigint")


def get_double(text, path: str) -> Column:
    return get(text, path, "double")


def get_boolean(text, path: str) -> Column:
    return get(text, path, "boolean")


def get_strings(text, path: str) -> Column:
    """An array of strings; other elements in their JSON form."""
    return get(text, path, "array<string>")


def get_char(text, path: str) -> Column:
    return F.nullif(F.substring(get(text, path), 1, 1), F.lit(""))


def get_date(text, path: str) -> Column:
    """A date as YYYYMMDD; 0 where there is none."""
    return F.coalesce(parse_date(get(text, path)), F.lit(0))


def pointer_tokens(pointer: str) -> list[str]:
    """Reference tokens of a JSON pointer, in plain (``/a/0``) or fragment form (``#/a/0``)."""
    if pointer.startswith("#"):
        pointer = urllib.parse.unquote(pointer[1:])
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise ValueError(f"a pointer begins with a slash: {pointer!r}")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/")]


def pointer_of(tokens: list[str], fragment: bool = False) -> str:
    plain = "".join("/" + t.replace("~", "~0").replace("/", "~1") for t in tokens)
    return "#" + urllib.parse.quote(plain, safe="/~") if fragment else plain


def query(text, pointer: str, kind: str = "string") -> Column:
    """The value that a pointer leads to; null where it leads nowhere.  Tokens of digits are taken as places in arrays."""
    path = "$" + "".join(f"[{t}]" if t.isdigit() else f"['{_quoted(t)}']" for t in pointer_tokens(pointer))
    return F.try_variant_get(F.try_parse_json(_c(text)), path, kind)


def fill(template, values: dict[str, Column]) -> Column:
    """A text with ``${NAME}`` replaced by values; unknown names stay."""
    out = _c(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("${" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def row_json(*columns: str) -> Column:
    """A row as JSON, nulls included."""
    return F.to_json(F.struct(*columns or ("*",)), {"ignoreNullFields": "false"})


def has_key(text, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(_c(text)), key), F.lit(False))


# --- objects and arrays


def members(text) -> Column:
    """An object as a map of its members."""
    return F.from_json(_c(text), "map<string,variant>")


def keys(text) -> Column:
    return F.json_object_keys(_c(text))


def size(text) -> Column:
    """How many members or elements."""
    return F.coalesce(F.json_array_length(_c(text)), F.size(F.json_object_keys(_c(text))).try_cast("int"))


def put(text, key: str, value) -> Column:
    """The object with a member set; ``value`` is JSON text, and null takes the member away."""
    rest = F.map_filter(members(text), lambda k, v: k != key)
    return F.to_json(F.when(_c(value).isNull(), rest).otherwise(F.map_concat(rest, F.create_map(F.lit(key), F.parse_json(F.coalesce(_c(value), F.lit("null")))))))


def increment(text, key: str, by: int = 1) -> Column:
    """The object with a number raised; a missing one counts from 0, anything else is an error."""
    old = get(text, f"{key}", "bigint")
    broken = has_key(text, key) & old.isNull()
    return F.when(broken, F.raise_error(f"{key} is no whole number").cast("string")).otherwise(put(text, key, (F.coalesce(old, F.lit(0)) + by).cast("string")))


def accumulate(text, key: str, value) -> Column:
    """The object with a value added: alone at first, then in an array with those before it; ``value`` is JSON text."""
    old, new = F.get_json_object(_c(text), json_path(key)), _c(value)
    raw = F.to_json(F.try_variant_get(F.try_parse_json(_c(text)), json_path(key), "variant"))
    inner = F.regexp_replace(F.regexp_replace(raw, r"^\[", ""), r"\]$", "")
    many = F.when(F.json_array_length(raw).isNotNull(), F.concat(F.lit("["), F.when(inner == "", new).otherwise(F.concat(inner, F.lit(","), new)), F.lit("]"))).otherwise(F.concat(F.lit("["), raw, F.lit(","), new, F.lit("]")))
    return put(text, key, F.when(old.isNull(), new).otherwise(many))


def append(text, key: str, value) -> Column:
    """The object with a value added to the array of that name, which is made where it is missing; another kind of member is an error."""
    raw = F.to_json(F.try_variant_get(F.try_parse_json(_c(text)), json_path(key), "variant"))
    broken = has_key(text, key) & F.json_array_length(raw).isNull()
    first = F.when(has_key(text, key), _c(text)).otherwise(put(text, key, F.lit("[]")))
    return F.when(broken, F.raise_error(f"{key} is no array").cast("string")).otherwise(accumulate(first, key, value))


def equal(one, other) -> Column:
    """Whether two JSON texts are the same value: members in any order, elements in theirs; null where either is no JSON."""
    return F.to_json(F.try_parse_json(_c(one))) == F.to_json(F.try_parse_json(_c(other)))


def put_once(text, key: str, value) -> Column:
    """As :func:`put`, but an error where the object has the member."""
    return F.when(has_key(text, key), F.raise_error(f"duplicate key {key}").cast("string")).otherwise(put(text, key, value))


def remove(text, key: str) -> Column:
    return F.to_json(F.map_filter(members(text), lambda k, v: k != key))


def subset(text, names: list[str]) -> Column:
    return F.to_json(F.map_filter(members(text), lambda k, v: k.isin(names)))


def zipped(values, names: list[str]) -> Column:
    """Elements of an array under names; the rest of either is left out."""
    arr = _c(values)
    n = F.least(F.size(arr), F.lit(len(names)))
    return F.to_json(F.map_from_arrays(F.slice(F.array(*[F.lit(x) for x in names]), F.lit(1), n), F.slice(arr, F.lit(1), n)))


def pretty(text) -> Column:
    return F.to_json(members(text), {"pretty": "true"})


def number_text(n) -> Column:
    """A number without a fraction that is zero, and without zeros at its end."""
    text = _c(n).cast("string")
    return F.when(text.rlike(r"^-?[0-9]+\.[0-9]+$"), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
