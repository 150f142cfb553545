"""XML and JSON into each other, comma-separated text and protocol texts into JSON, MIME types.

The conversions are plain functions on one text; :func:`on_batches` makes a column function of any of them.
"""

from __future__ import annotations

import csv
import io
import json
import re
import urllib.parse
import xml.dom.minidom
import xml.etree.ElementTree as Tree
from collections.abc import Callable
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# MIME types by file extension.
MIME = {
    "aac": "audio/aac", "abw": "application/x-abiword", "arc": "application/x-freearc", "avi": "video/x-msvideo", "azw": "application/vnd.amazon.ebook",
    "bin": "application/octet-stream", "bmp": "image/bmp", "bz": "application/x-bzip", "bz2": "application/x-bzip2", "cda": "application/x-cdf", "csh": "application/x-csh",
    "css": "text/css", "csv": "text/csv", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "eot": "application/vnd.ms-fontobject", "epub": "application/epub+zip", "gz": "application/gzip", "gif": "image/gif", "htm": "text/html", "html": "text/html",
    "ico": "image/vnd.microsoft.icon", "ics": "text/calendar", "jar": "application/java-archive", "jpeg": "image/jpeg", "jpg": "image/jpeg", "js": "text/javascript",
    "json": "application/json", "jsonld": "application/ld+json", "mid": "audio/x-midi", "midi": "audio/x-midi", "mjs": "text/javascript", "mp3": "audio/mpeg",
    "mp4": "video/mp4", "mpeg": "video/mpeg", "mpg": "video/mpeg", "mpkg": "application/vnd.apple.installer+xml", "odp": "application/vnd.oasis.opendocument.presentation",
    "ods": "application/vnd.oasis.opendocument.spreadsheet", "odt": "application/vnd.oasis.opendocument.text", "oga": "audio/ogg", "ogv": "video/ogg", "ogx": "application/ogg",
    "opus": "audio/opus", "otf": "font/otf", "png": "image/png", "pdf": "application/pdf", "php": "application/x-httpd-php", "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "rar": "application/vnd.rar", "rtf": "application/rtf", "sh": "application/x-sh",
    "svg": "image/svg+xml", "swf": "application/x-shockwave-flash", "tar": "application/x-tar", "tif": "image/tiff", "tiff": "image/tiff", "ts": "video/mp2t", "ttf": "font/ttf",
    "txt": "text/plain", "vsd": "application/vnd.visio", "wav": "audio/wav", "weba": "audio/webm", "webm": "video/webm", "webp": "image/webp", "woff": "font/woff",
    "woff2": "font/woff2", "xhtml": "application/xhtml+xml", "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xml": "application/xml", "xul": "application/vnd.mozilla.xul+xml", "zip": "application/zip", "3gp": "audio/3gpp",
}
NO_MIME = "application/octet-stream"


def mime_type(name: Column) -> Column:
    """By what follows the last dot, or by the whole text where there is none."""
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.substring_index(name, ".", -1))), F.lit(NO_MIME))


def on_batches(convert: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A column function of a function on one text; null stays null, and so does what cannot be converted."""

    def each(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return convert(text)
        except (ValueError, KeyError, IndexError, Tree.ParseError):
            return None

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([each(t) for t in texts], dtype=object)

    return run


def string_to_value(text: str):
    """A text as the value that it spells: true, false, null, a whole number, a number, or itself."""
    plain = {"true": True, "false": False, "null": None}
    if text.lower() in plain:
        return plain[text.lower()]
    if re.fullmatch(r"-?(0|[1-9]\d{0,17})", text) and text != "-0":
        return int(text)
    if re.fullmatch(r"-?\d+(\.\d+)?([eE][+-]?\d+)?", text) and not re.match(r"-?0\d", text):
        return float(text)
    return text


def _add(into: dict, name: str, value) -> None:
    """Repeated names gather in a list."""
    if name not in into:
        into[name] = value
    elif isinstance(into[name], list):
        into[name].append(value)
    else:
        into[name] = [into[name], value]


def _element(node: Tree.Element, strings: bool):
    value = (lambda t: t) if strings else string_to_value
    out: dict = {}
    for name, text in node.attrib.items():
        _add(out, name, value(text))
    texts = [node.text, *(c.tail for c in node)]
    for text in texts:
        if text and text.strip():
            _add(out, "content", value(text.strip()))
    for child in node:
        _add(out, child.tag, _element(child, strings))
    if set(out) == {"content"} and not isinstance(out["content"], list):
        return out["content"]
    return out or ""


def xml_to_json(text: str, strings: bool = False) -> str:
    """Attributes and child elements as members, repeated ones as lists, text as ``content``; ``strings`` leaves values as they are spelled."""
    root = Tree.fromstring(text)
    return json.dumps({root.tag: _element(root, strings)})


def _as_xml(value, tag: str | None) -> str:
    if isinstance(value, dict):
        inner = "".join(escape(str(v)) if k == "content" and not isinstance(v, (dict, list)) else _as_xml(v, k) for k, v in value.items())
        return f"<{tag}>{inner}</{tag}>" if tag else inner
    if isinstance(value, list):
        return "".join(_as_xml(v, tag or "array") for v in value) if value else ""
    text = "null" if value is None else str(value).lower() if isinstance(value, bool) else escape(str(value))
    if tag is None:
        return f'"{text}"'
    return f"<{tag}>{text}</{tag}>" if text else f"<{tag}/>"


def json_to_xml(text: str, tag: str | None = None) -> str:
    return _as_xml(json.loads(text), tag)


def xml_pretty(text: str) -> str:
    return xml.dom.minidom.parseString(text).toprettyxml(indent="    ")


def xml_to_array(text: str) -> str:
    """The array form: ``[tag, {attributes}, children...]``."""

    def form(node: Tree.Element) -> list:
        out: list = [node.tag]
        if node.attrib:
            out.append({k: string_to_value(v) for k, v in node.attrib.items()})
        if node.text and node.text.strip():
            out.append(string_to_value(node.text.strip()))
        for child in node:
            out.append(form(child))
            if child.tail and child.tail.strip():
                out.append(string_to_value(child.tail.strip()))
        return out

    return json.dumps(form(Tree.fromstring(text)))


def array_to_xml(text: str) -> str:
    def form(value) -> str:
        if not isinstance(value, list):
            return escape(str(value).lower() if isinstance(value, bool) else str(value))
        tag, *rest = value
        attributes = rest.pop(0) if rest and isinstance(rest[0], dict) else {}
        head = tag + "".join(f" {k}={quoteattr(str(v))}" for k, v in attributes.items())
        return f"<{head}>{''.join(map(form, rest))}</{tag}>" if rest else f"<{head}/>"

    return form(json.loads(text))


# --- comma-separated text


def csv_to_json(text: str, names: list[str] | None = None) -> str:
    """Rows of comma-separated text as objects; the first row names the members unless ``names`` does."""
    rows = [[v.strip() for v in r] for r in csv.reader(io.StringIO(text), skipinitialspace=True) if r]
    header = names if names is not None else (rows.pop(0) if rows else [])
    return json.dumps([dict(zip(header, map(string_to_value, r), strict=False)) for r in rows])


def json_to_csv(text: str, names: list[str] | None = None) -> str:
    """Objects as comma-separated text with a header; control characters and quotes inside values are left out."""
    rows = json.loads(text)
    header = names or (list(rows[0]) if rows else [])

    def shown(value) -> str:
        plain = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        return '"' + re.sub(r'[\x00-\x1f"]', "", plain) + '"' if re.search(r'[,"\x00-\x1f]', plain) or plain[:1] == '"' else plain

    return "".join(",".join(map(shown, r)) + "\n" for r in [header, *([row.get(n) for n in header] for row in rows)])


# --- protocol texts


def http_to_json(text: str) -> str:
    """A request's or response's head: its first line in members of their names, then the header fields."""
    first, *lines = text.replace("\r\n", "\n").split("\n")
    a, b, c = (first.split(" ", 2) + ["", ""])[:3]
    out = {"HTTP-Version": a, "Status-Code": b, "Reason-Phrase": c} if a.upper().startswith("HTTP") else {"Method": a, "Request-URI": b, "HTTP-Version": c}
    for line in lines:
        if not line.strip():
            break
        name, _, value = line.partition(":")
        out[name.strip()] = value.strip()
    return json.dumps(out)


def json_to_http(text: str) -> str:
    fields = json.loads(text)
    order = ("HTTP-Version", "Status-Code", "Reason-Phrase") if "Status-Code" in fields else ("Method", "Request-URI", "HTTP-Version")
    head = " ".join(str(fields[k]) for k in order)
    return "\r\n".join([head, *(f"{k}: {v}" for k, v in fields.items() if k not in order and v is not None), "", ""])


def cookie_to_json(text: str) -> str:
    """``name=value; attribute=value; secure`` as an object; name and value are in members of these names."""
    first, *rest = text.split(";")
    name, _, value = first.partition("=")
    out: dict = {"name": urllib.parse.unquote(name.strip()), "value": urllib.parse.unquote(value.strip())}
    for part in rest:
        key, sign, value = part.partition("=")
        if key.strip():
            out[urllib.parse.unquote(key.strip())] = urllib.parse.unquote(value.strip()) if sign else True
    return json.dumps(out)


def json_to_cookie(text: str) -> str:
    fields = json.loads(text)
    code = lambda s: re.sub(r"[+%=;\x00-\x1f]", lambda m: f"%{ord(m[0]):02x}", str(s).strip())
    rest = [k if v is True else f"{code(k)}={code(v)}" for k, v in fields.items() if k not in ("name", "value") and v is not False and v is not None]
    return ";".join([f"{code(fields['name'])}={code(fields['value'])}", *rest])


def cookies_to_json(text: str) -> str:
    pairs = (p.partition("=") for p in text.split(";") if p.strip())
    return json.dumps({urllib.parse.unquote(k.strip()): urllib.parse.unquote(v.strip()) for k, _, v in pairs})


def properties_to_json(text: str) -> str:
    """``a.b = c`` lines as nested objects."""
    out: dict = {}
    for line in text.splitlines():
        if line.strip() and line.strip()[0] not in "#!" and "=" in line:
            key, _, value = line.partition("=")
            *path, last = key.strip().split(".")
            at = out
            for step in path:
                at = at.setdefault(step, {})
            at[last] = value.strip()
    return json.dumps(out)
