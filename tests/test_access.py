"""Statements, catalogue relations, typed access, the index's single commit, approximate search and small functions."""

import datetime
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream import service
from lodestream.functions import dates, jsons, strings
from lodestream.operators import ann, index, search
from lodestream.operators.embedding import HashingEmbedder
from lodestream.plans import statements
from lodestream.plans.access import Database
from lodestream.plans.graph import RelationGraph
from lodestream.sources import config, delimited, files
from lodestream.sources.store import SnapshotTable
from lodestream.streaming import sweep


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_statements_are_taken_apart():
    s = statements.parse("UPDATE t SET a = concat(b, ', where'), c=(SELECT max(x) FROM y WHERE z = 1) WHERE d = 'x=1'")
    assert s.columns == ("a", "c") and s.values == ("concat(b, ', where')", "(SELECT max(x) FROM y WHERE z = 1)") and s.condition == "d = 'x=1'"
    assert statements.parse("delete from T;").table == "t"
    assert statements.parse("insert into t (a, B) values (1, 2)").columns == ("a", "b")
    for bad in ("DROP TABLE t", "DELETE FROM t LIMIT 3", "UPDATE t SET a"):
        with pytest.raises(ValueError):
            statements.parse(bad)


def test_statements_on_a_store(spark, tmp_path):
    store = SnapshotTable(spark, str(tmp_path / "t"), "k int, v string", keys=["k"], buckets=4)
    store.write(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"))
    db = Database(spark)
    db.attach("own_t", store, ["k"])
    assert db.execute("UPDATE own_t SET v = 'what?' WHERE v = ?", "a") == 1
    assert db.execute("DELETE FROM own_t WHERE v = ?", "nothing") == 0
    assert db.execute("DELETE FROM own_t WHERE v <> 'what?'") == 1  # null is not unlike anything
    assert db.execute("INSERT INTO own_t VALUES (?, ?), (9, 'i')", 8, "h") == 2
    assert sorted(map(tuple, store.read().collect())) == [(1, "what?"), (2, None), (8, "h"), (9, "i")]
    n, rows = db.cursor_with_count("SELECT k FROM own_t ORDER BY k")
    assert n == 4 and [r["k"] for r in rows] == [1, 2, 8, 9]
    with pytest.raises(ValueError, match="values"):
        db.execute("INSERT INTO own_t (k) VALUES (1, 2)")
    with pytest.raises(KeyError):
        db.execute("DELETE FROM elsewhere")
    db.read_only = True
    with pytest.raises(PermissionError):
        db.execute("DELETE FROM own_t")


def test_relations_of_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url + ";create=true")
    statement = connection.createStatement()
    for text in (
        "CREATE TABLE dept (id INT PRIMARY KEY)",
        "CREATE TABLE pair (a INT NOT NULL, b INT NOT NULL, PRIMARY KEY (a, b))",
        "CREATE TABLE emp (id INT PRIMARY KEY, dept INT REFERENCES dept (id), x INT, y INT, FOREIGN KEY (x, y) REFERENCES pair (a, b))",
    ):
        statement.execute(text)
    connection.close()
    graph = RelationGraph.from_jdbc(spark, url, "APP")
    assert sorted(graph.tables) == ["dept", "emp", "pair"]
    assert [e.condition() for e in graph.join_path(["dept", "pair"], "emp")] == ["emp.dept = dept.id", "emp.x = pair.a AND emp.y = pair.b"]
    assert RelationGraph.from_jdbc(spark, url, "APP") is graph


def test_typed_access(spark):
    spark.createDataFrame([(datetime.datetime(2024, 2, 29, 12, 30), bytearray(b"ab"))], "at timestamp, b binary").createOrReplaceTempView("typed_rows")
    db = Database(spark)
    r = db.record("typed_rows", "SELECT * FROM typed_rows")
    assert r.get_bytes("b") == b"ab" and r.get_datetime("at").hour == 12 and r.get_time_ms("at") == 45_000_000
    assert r.get_datetime("at", "America/New_York").hour == 7 and r.get_datetime_ms("at") == 1_709_209_800_000
    r.set_date("d", 20240229).set_date("none", 0).set_datetime("s", 1_709_209_800_000).set_datetime("n", 0).set_time("t", 930)
    assert (r["d"], r["none"], r["s"], r["n"], r["t"]) == (datetime.date(2024, 2, 29), None, datetime.datetime(2024, 2, 29, 12, 30), None, "09:30:00")
    assert r.get_datetime_ms("n") == 0 and r.get_time_ms("n") == 0 and r.to_json({"x": 1})["x"] == 1
    spark.createDataFrame([("a",)], "s string").select(F.lit(1).cast("decimal(9,2)").alias("n"), "s").createOrReplaceTempView("sized")
    assert db.column_size("sized", "N") == 9 and db.column_size("sized", "s") is None
    with pytest.raises(KeyError):
        db.column_size("sized", "zz")


def test_now_and_zones(spark):
    n = one(spark, dates.now("Asia/Tokyo"))
    assert abs((datetime.datetime.strptime(str(n), "%Y%m%d%H%M") - datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)).total_seconds() - 9 * 3600) < 180
    assert 0 <= one(spark, dates.now_time()) <= 2359 and one(spark, dates.now_text("yyyy")) >= "2024"
    assert one(spark, dates.in_zone(F.lit(202401011200), "UTC", "America/New_York")) == 202401010700


def test_json_members(spark):
    get = lambda c: one(spark, c)
    o = F.lit('{"a":1,"b":[2,"x"],"c":"t"}')
    assert get(jsons.increment(o, "a", 2)) == '{"b":[2,"x"],"c":"t","a":3}'
    assert get(jsons.accumulate(o, "b", F.lit("{}"))) == '{"a":1,"c":"t","b":[2,"x",{}]}'
    assert get(jsons.accumulate(o, "new", F.lit("5"))) == '{"a":1,"b":[2,"x"],"c":"t","new":5}'
    assert get(jsons.append(o, "new", F.lit("5"))) == '{"a":1,"b":[2,"x"],"c":"t","new":[5]}'
    assert get(jsons.equal(F.lit('{"a":1,"b":2}'), F.lit('{ "b":2, "a":1 }'))) and not get(jsons.equal(F.lit("[1,2]"), F.lit("[2,1]")))
    for broken in (jsons.increment(o, "c"), jsons.append(o, "a", F.lit("1"))):
        with pytest.raises(Exception, match="is no"):
            get(broken)
    assert get(strings.printf("%05d|%s", F.lit(42), F.lit("x"))) == "00042|x"
    assert get(strings.could_be_binary(F.lit("QUJD"))) and not get(strings.could_be_binary(F.lit("a b!")))


def test_text_files_and_raw_rows(spark, tmp_path):
    path = str(tmp_path / "a.txt")
    files.write_text(spark, path, 'x,"1,""2"""\n')
    files.write_text(spark, path, "y,é\n", append=True)
    assert files.read_text(spark, path) == 'x,"1,""2"""\ny,é\n'
    rows = {r["a"]: r for r in delimited.read_raw(spark, path, ["a", "b"], expect=2).collect()}
    assert rows["x"]["b"] == '1,"2"' and rows["x"]["raw"] == 'x,"1,""2"""' and rows["y"]["n_fields"] == 2
    files.write_text(spark, path, "z\n", append=True)
    with pytest.raises(Exception, match="not 2 fields"):
        delimited.read_raw(spark, path, ["a", "b"], expect=2).collect()


def test_an_older_row_of_a_stream_changes_nothing(spark, tmp_path):
    schema = "k int, v string, at int, _rank int"
    table = SnapshotTable(spark, str(tmp_path / "t"), schema, keys=["k"], buckets=4)
    source = str(tmp_path / "in")
    for rows in ([(1, "new", 5, 7)], [(1, "old", 3, 8), (2, "x", 1, 9)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        sweep.upsert_stream(sweep.read_stream(spark, source, schema), table, ["k"], "at", str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(tuple, table.read().collect())) == [(1, "new", 5, 7), (2, "x", 1, 9)]


@pytest.fixture()
def indexed(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.py").write_text("def first(x):\n  return x\n")
    (root / "b.md").write_text("# Title\nabout widgets\n")
    projects = config.Projects.of({"projects": [{"name": "demo", "roots": [str(root)]}]})
    catalog = index.Catalog(spark, str(tmp_path / "index"), projects, config.Settings(dimension=16), HashingEmbedder(16))
    catalog.index("demo").sweep(projects.get("demo"))
    return root, catalog


def test_files_and_chunks_change_by_one_commit(spark, indexed, monkeypatch):
    root, catalog = indexed
    own, project = catalog.index("demo"), catalog.projects.get("demo")
    before = sorted(map(str, own.chunks.read().drop("embedding").collect())), sorted(map(str, own.files.read().collect()))
    (root / "a.py").write_text("def second(y):\n  return y\n")

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(own, "_commit", crash)
        with pytest.raises(RuntimeError, match="lost"):
            own.sweep(project)
    # both tables have new versions, and neither counts
    assert (sorted(map(str, own.chunks.read().drop("embedding").collect())), sorted(map(str, own.files.read().collect()))) == before
    assert own.chunks.version > own.chunks.current
    assert own.sweep(project)["indexed"] == 1
    assert any("second" in r["content"] for r in own.chunks.read().collect()) and own.chunks.read().count() == 2


def test_reindex_in_the_background_and_plan(indexed):
    root, catalog = indexed
    (root / "c.md").write_text("# More\ntext\n")
    thread = catalog.reindex_async("demo")
    assert isinstance(thread, threading.Thread)
    with pytest.raises(index.Busy):
        catalog.reindex_async("demo")
    thread.join(120)
    assert catalog.index("demo").files.read().count() == 3
    assert catalog.plan_text() == "Nothing differs."
    catalog.projects = config.Projects.of({"projects": [{"name": "other", "roots": [str(root)]}]})
    assert catalog.plan_text() == "Would do:\n  create project other\n  drop project demo (3 files)"
    assert catalog.plan_text(execute=True).startswith("Done:") and catalog.stored() == ["other"]


def test_requests_are_authorized_by_project(indexed):
    own = service.Service(indexed[1])
    assert own.authorized("/mcp/demo?x=1", {}, None) == "demo"
    assert own.authorized("/mcp/demo/", {"Authorization": "Bearer abc"}, {"demo": "abc"}) == "demo"
    for path, headers in (("/mcp/none", {}), ("/mcp/demo", {}), ("/mcp/demo", {"authorization": "Bearer x"}), ("/mcp/demo", {"authorization": "Basic abc"})):
        with pytest.raises(service.ToolError):
            own.authorized(path, headers, {"demo": "abc"})


def test_search_reads_contents_of_the_best_rows_only(spark, indexed):
    own = indexed[1].index("demo")
    began = time.time()
    hits = search.search_text(own.files.read(), own.chunks.read(), own.model, "about widgets", k=1).collect()
    assert len(hits) == 1 and "widgets" in hits[0]["snippet"] and time.time() - began < 60
    assert search.search_text(own.files.read(), own.chunks.read(), own.model, "x", repo="none").collect() == []


def test_recall_of_the_lists(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").orderBy("vec_id").collect()
    lists = ann.ListIndex.build(vectors, str(tmp_path / "lists"), "vec_id")
    assert lists.read().count() == len(rows) and set(lists.read().columns) == {*vectors.columns, "list"}
    own = np.array([r["embedding"] for r in rows], np.float64)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    found = 0
    queries = list(range(0, len(rows), max(1, len(rows) // 25)))[:25]
    for q in queries:
        true = {rows[i]["vec_id"] for i in np.argsort(-(own @ own[q]), kind="stable")[:10]}
        found += len(true & {r["vec_id"] for r in lists.top_k(rows[q]["embedding"], 10).collect()})
    assert found / (10 * len(queries)) >= 0.9
    every = [r["vec_id"] for r in lists.top_k(rows[0]["embedding"], 10, depth=ann.LISTS).collect()]
    assert every == [r["vec_id"] for r in search.top_k(vectors, rows[0]["embedding"], 10, id_col="vec_id").collect()]
    empty = ann.ListIndex.build(vectors.limit(0), str(tmp_path / "none"), "vec_id")
    assert empty.centres.shape == (1, 1)
