import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lodestream.functions import jsons, numbers
from lodestream.operators.embedding import HttpEmbedder, TooLong, embed_range
from lodestream.operators.vectors import VectorStore
from lodestream.sources import rest


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.answer(200, "<a><b>1</b></a>" if "xml" in self.path else '{"path": "%s"}' % self.path)

        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            if any(len(t) > 500 for t in texts):
                self.answer(400, "input exceeds the context length")
            else:
                self.answer(200, json.dumps({"embeddings": [[float(len(t)), 1.0] for t in texts]}))

        def answer(self, code, text):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    own = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def test_rest(spark, server):
    assert rest.call_json(f"{server}/x") == {"path": "/x"} and rest.call_xml(f"{server}/xml").find("b").text == "1"
    rows = {r["url"]: r for r in rest.fetched(spark.createDataFrame([(f"{server}/1",), ("http://127.0.0.1:9/",)], "url string")).collect()}
    assert rows[f"{server}/1"]["body"] == '{"path": "/1"}' and rows["http://127.0.0.1:9/"]["error"]


def test_http_embedder(server):
    model = HttpEmbedder(server, "m", 2)
    assert model.embed(["abc", "d"]).tolist() == [[3, 1], [1, 1]]
    with pytest.raises(TooLong):
        model.embed(["x" * 600])
    assert embed_range(model, ["a", "x" * 800, "b"]).tolist() == [[1, 1], [400, 1], [1, 1]]


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    one = store.create("one", 2)
    assert store.names() == ["one"]
    ids = one.put([{"id": "a", "text": "x", "embedding": [1, 0], "kind": "p"}, {"text": "y", "embedding": [0, 1], "kind": "q", "document_id": "d"}])
    assert ids[0] == "a" and [r["id"] for r in one.search([1, 0.1], 1).collect()] == ["a"]
    assert [r["id"] for r in one.search([1, 0], 5, {"kind": "q", "document_id": "d"}).collect()] == [ids[1]]
    one.put([{"id": "a", "text": "z", "embedding": [0, 1]}])
    assert one.get("a")["text"] == "z" and one.get("none") is None and one.table.read().count() == 2
    one.delete("a")
    assert one.get("a") is None
    with pytest.raises(Exception, match="have 2 numbers"):
        one.put([{"embedding": [1]}])
    for bad in ("one", "Bad"):
        with pytest.raises(ValueError):
            store.create(bad, 2)
    store.drop("one")
    with pytest.raises(KeyError):
        store.open("one")


def test_json_objects(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    p = F.lit('{"a": 1, "b": [1, "x"], "c": {"d": null}}')
    assert json.loads(get(jsons.put(p, "a", F.lit('"new"')))) == {"a": "new", "b": [1, "x"], "c": {"d": None}}
    assert json.loads(get(jsons.put(p, "a", F.lit(None).cast("string")))) == json.loads(get(jsons.remove(p, "a"))) == {"b": [1, "x"], "c": {"d": None}}
    assert json.loads(get(jsons.put_once(p, "z", F.lit("2"))))["z"] == 2
    with pytest.raises(Exception, match="duplicate key"):
        get(jsons.put_once(p, "a", F.lit("2")))
    assert json.loads(get(jsons.subset(p, ["a", "none"]))) == {"a": 1} and get(jsons.keys(p)) == ["a", "b", "c"] and get(jsons.size(p)) == 3 and get(jsons.size(F.lit("[1,2]"))) == 2
    assert json.loads(get(jsons.zipped(F.array(F.lit("x"), F.lit("y"), F.lit("z")), ["m", "n"]))) == {"m": "x", "n": "y"}
    assert "\n" in get(jsons.pretty(p)) and [get(jsons.number_text(F.lit(v))) for v in (1.0, 2.5, 100)] == ["1", "2.5", "100"]
    assert numbers.picture_for_proportional_type(1234.5, "C", 10, 1) == " " + "   1,234.5".replace(" ", "  ")
    assert json.loads(get(jsons.row_json()))["id"] == 0
