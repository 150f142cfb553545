"""HTTP services as sources: JSON, XML and text answers."""

from __future__ import annotations

import json
import urllib.request
import xml.etree.ElementTree as Tree
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


def call_text(url: str, method: str = "GET", body: str | bytes | None = None, headers: dict[str, str] | None = None, timeout: float = 60.0) -> str:
    data = body.encode() if isinstance(body, str) else body
    request = urllib.request.Request(url, data, headers or {}, method=method)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")


def call_json(url: str, method: str = "GET", body: Any = None, headers: dict[str, str] | None = None, timeout: float = 60.0) -> Any:
    data = None if body is None else json.dumps(body)
    return json.loads(call_text(url, method, data, {"Content-Type": "application/json", "Accept": "application/json"} | (headers or {}), timeout))


def call_xml(url: str, method: str = "GET", body: str | None = None, headers: dict[str, str] | None = None, timeout: float = 60.0) -> Tree.Element:
    return Tree.fromstring(call_text(url, method, body, {"Content-Type": "application/xml"} | (headers or {}), timeout))


def fetched(requests: DataFrame, url_col: str = "url", timeout: float = 60.0) -> DataFrame:
    """``url, body, error`` for a table of addresses, fetched by the tasks that hold them; partitioning decides how many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column("url").to_pylist():
                body = error = None
                try:
                    body = call_text(url, timeout=timeout)
                except (OSError, ValueError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([body], pa.string()), pa.array([error], pa.string())], names=["url", "body", "error"])

    return requests.selectExpr(f"`{url_col}` AS url").mapInArrow(run, "url string, body string, error string")
