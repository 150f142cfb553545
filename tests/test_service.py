import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestream.functions import markup
from lodestream.operators.index import Catalog
from lodestream.service import Service
from lodestream.sources import config
from lodestream.streaming.schedule import Line, parse_table, run_due


def test_tools(spark, tmp_path):
    root = tmp_path / "code"
    root.mkdir()
    (root / "a.md").write_text("# Pump\nhow the pump is primed\n")
    catalog = Catalog(spark, str(tmp_path / "i"), config.Projects.of({"projects": [{"name": "one", "roots": [str(root)]}]}), config.Settings(dimension=16))
    catalog.sweep_all()
    service = Service(catalog)
    ask = lambda method, **params: service.handle("one", {"id": 1, "method": method, "params": params})
    assert ask("ping")["result"] == {} and ask("initialize")["result"]["serverInfo"]["name"] == "lodestream" and service.handle("one", {"method": "notifications/x"}) is None
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["search_code", "get_chunk", "list_repos", "index_status"]
    assert ask("nonsense")["error"]["code"] == -32601

    def tool(name, **arguments):
        result = ask("tools/call", name=name, arguments=arguments)["result"]
        return result["isError"], result["content"][0]["text"]

    failed, text = tool("search_code", query="pump")
    found = json.loads(text)
    assert not failed and found["count"] == 1 and found["hits"][0]["symbol"] == "Pump"
    assert "primed" in json.loads(tool("get_chunk", chunk_id=found["hits"][0]["chunk_id"])[1])["content"]
    assert json.loads(tool("list_repos")[1])["repos"][0]["files"] == 1 and json.loads(tool("index_status")[1])["chunks"] == 1
    assert tool("search_code")[0] and tool("get_chunk")[0] and tool("get_chunk", chunk_id=5)[0] and tool("other") == (True, "unknown tool: other")
    with pytest.raises(Exception, match="unknown project"):
        service.call("two", "list_repos")


def test_schedule():
    every = Line.parse("*/10 * * * * sweep all")
    assert every.command == "sweep all" and every.due(datetime(2024, 1, 1, 5, 20)) and not every.due(datetime(2024, 1, 1, 5, 21))
    line = Line.parse("0,30 8-10 1 * 7 x")
    assert line.due(datetime(2024, 9, 1, 9, 30)) and not line.due(datetime(2024, 9, 2, 9, 30)) and not line.due(datetime(2024, 9, 1, 11, 0))
    for bad in ("* * * *", "61 * * * * x", "5-1 * * * * x"):
        with pytest.raises(ValueError):
            Line.parse(bad)
    done = []
    table = parse_table("# a comment\n* * * * * good\n\n* * * * * bad\n")
    assert run_due(table, datetime(2024, 1, 1), {"good": lambda: done.append(1), "bad": lambda: 1 / 0}) == {"good": "done", "bad": "failed: division by zero"}


def test_markup():
    as_json = lambda f, x: json.loads(f(x))
    assert as_json(markup.xml_to_json, "<r a='1'><x>1.5</x><x>true</x><y>t</y>c</r>") == {"r": {"a": 1, "x": [1.5, True], "y": "t", "content": "c"}}
    assert as_json(lambda x: markup.xml_to_json(x, True), "<r><x>01</x></r>") == {"r": {"x": "01"}}
    assert markup.json_to_xml('{"r": {"x": [1, 2], "y": "<", "content": "c"}}') == "<r><x>1</x><x>2</x><y>&lt;</y>c</r>"
    assert [markup.string_to_value(t) for t in ("007", "-0", "1e3", "x", "null", "12")] == ["007", -0.0, 1000.0, "x", None, 12]
    text = '<a k="1"><b>x</b>tail</a>'
    assert as_json(markup.xml_to_array, text) == ["a", {"k": 1}, ["b", "x"], "tail"] and markup.array_to_xml(markup.xml_to_array(text)) == text
    assert "\n    <b>" in markup.xml_pretty(text)
    assert as_json(markup.csv_to_json, 'n,q\n"a, b",3\n') == [{"n": "a, b", "q": 3}] and as_json(lambda x: markup.csv_to_json(x, ["z"]), "1\n") == [{"z": 1}]
    assert markup.json_to_csv('[{"n": "a, b", "q": 3}, {"n": null}]') == 'n,q\n"a, b",3\n,\n'
    head = "GET /x HTTP/1.1\r\nHost: h\r\n\r\n"
    assert as_json(markup.http_to_json, head)["Host"] == "h" and markup.json_to_http(markup.http_to_json(head)) == head
    assert as_json(markup.http_to_json, "HTTP/1.1 404 Not Found")["Reason-Phrase"] == "Not Found"
    cookie = "a=b%3bc;path=/;secure"
    assert as_json(markup.cookie_to_json, cookie) == {"name": "a", "value": "b;c", "path": "/", "secure": True} and markup.json_to_cookie(markup.cookie_to_json(cookie)) == cookie
    assert as_json(markup.cookies_to_json, "a=1; b=2") == {"a": "1", "b": "2"} and as_json(markup.properties_to_json, "#c\na.b=1\na.c = x\n") == {"a": {"b": "1", "c": "x"}}


def test_markup_columns(spark):
    df = spark.createDataFrame([("<a>1</a>",), ("<broken",), (None,)], "x string")
    assert [r[0] for r in df.select(markup.on_batches(markup.xml_to_json)("x")).collect()] == ['{"a": 1}', None, None]
    names = spark.createDataFrame([("a.PNG",), ("json",), ("x.",), ("y.zzz",)], "n string")
    assert [r[0] for r in names.select(markup.mime_type(F.col("n"))).collect()] == ["image/png", "application/json", markup.NO_MIME, markup.NO_MIME]
