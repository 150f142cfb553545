import os

import pytest
from pyspark.sql import functions as F

from lodestream.operators import index, search
from lodestream.operators.embedding import HashingEmbedder
from lodestream.plans.access import Database
from lodestream.sources import config, delimited, files
from lodestream.sources.languages import extension_of, language_of
from lodestream.sources.store import SnapshotTable
from lodestream.streaming import sweep


def test_languages():
    assert [language_of(n) for n in (".env", "Makefile", "CMakeLists.txt", "README", "x/A.JAVA", "a.", "Dockerfile", "b.tsx")] == ["ini", "makefile", "text", None, "java", None, "dockerfile", "typescript"]
    assert extension_of("a.b.C") == "c" and extension_of("a") == ""


@pytest.mark.parametrize(
    ("glob", "path", "match"),
    [("**/build", "/a/b/build", True), ("**/build/**", "/a/build/x/y", True), ("**/*.jar", "/a/x.jar", True), ("/a/*.jar", "/a/b/x.jar", False), ("**/{x,y}.py", "/q/y.py", True), ("**/[!a].c", "/b.c", True), ("**/[!a].c", "/a.c", False), ("/a?c", "/abc", True), ("/a?c", "/a/c", False)],
)
def test_globs(glob, path, match):
    import re

    assert bool(re.fullmatch(files.glob_to_regex(glob), path)) == match


def test_configuration(tmp_path):
    good = {"projects": [{"name": "one", "roots": ["/a/x", "/b/y"], "excludeGlobs": []}, {"name": "two", "roots": ["/c"]}]}
    projects = config.Projects.of(good)
    assert projects.names == ["one", "two"] and projects.get("one").excludes == () and projects.get("two").excludes == config.DEFAULT_EXCLUDES
    assert projects.get("one").root_of("y") == "/b/y"
    for bad in ({"projects": []}, {"projects": [{"name": "No", "roots": ["/a"]}]}, {"projects": [{"name": "a", "roots": []}]}, {"projects": [{"name": "a", "roots": ["/x"]}] * 2}, {"projects": [{"name": "a", "roots": ["/x/r", "/y/r"]}]}):
        with pytest.raises(ValueError):
            config.Projects.of(bad)
    with pytest.raises(KeyError):
        projects.get("none")
    (tmp_path / "a.ini").write_text("Top = 1\n[main]\nEmbeddingDim = 64\nOther\n")
    ini = config.load_ini(str(tmp_path / "a.ini"))
    assert ini[""]["Top"] == "1" and config.Settings.of(ini["main"]).dimension == 64 and config.Settings.of({}).batch_texts == 32
    assert config.jdbc_options("postgresql", "d")["url"] == "jdbc:postgresql://localhost:5432/d"


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "repo"
    (root / ".hidden").mkdir(parents=True)
    (root / "build").mkdir()
    (root / "a.py").write_text("import os\n\ndef first(x):\n  return x\n")
    (root / ".hidden" / "b.md").write_text("# Title\ntext about widgets\n")
    (root / "build" / "c.py").write_text("x = 1\n")
    (root / "bin.txt").write_bytes(b"a\0b")
    (root / "bad.txt").write_bytes(b"\xff\xfeab")
    (root / "blank.txt").write_text(" \n")
    (root / "README").write_text("no language")
    (root / "big.txt").write_bytes(b"x" * 1_048_577)
    return root


def test_scan(spark, tree):
    listing = files.list_roots([str(tree), str(tree / "none")], config.DEFAULT_EXCLUDES)
    assert [f[1] for f in listing.files] == ["a.py", "bad.txt", "bin.txt", "blank.txt", ".hidden/b.md"] and listing.skipped == 2 and len(listing.missing) == 1
    rows = {r["path"]: r for r in files.scan(spark, listing).collect()}
    assert rows["bad.txt"]["content"] == "\ufffd\ufffdab" and rows["bin.txt"]["content"] is None and rows["blank.txt"]["content"] is None
    assert len(rows["a.py"]["sha256"]) == 64 and rows["a.py"]["language"] == "python"


def test_sweep_cycle(spark, tree, tmp_path):
    project = config.Project("demo", (str(tree),))
    own = index.Index(spark, str(tmp_path / "index"), "demo", config.Settings(dimension=32), HashingEmbedder(32))
    assert own.bootstrap()
    one = own.sweep(project)
    assert (one["scanned"], one["indexed"], one["unchanged"], one["deleted"]) == (5, 3, 0, 0)
    ids = {r["path"]: r["file_id"] for r in own.files.read().collect()}
    version = own.files.version
    two = own.sweep(project)
    assert (two["indexed"], two["unchanged"], two["chunksInserted"]) == (0, 3, 0) and own.files.version == version
    (tree / "a.py").write_text("def second(y):\n  return y\n")
    (tree / "bad.txt").unlink()
    (tree / "d.go").write_text("package d\nfunc Run() {\n}\n")
    three = own.sweep(project)
    assert (three["indexed"], three["unchanged"], three["deleted"]) == (2, 1, 1)
    found = {r["path"]: r["file_id"] for r in own.files.read().collect()}
    assert set(found) == {"a.py", "d.go", ".hidden/b.md"} and found["a.py"] == ids["a.py"]
    symbols = {r["symbol"] for r in own.chunks.read().collect()}
    assert "second" in symbols and "first" not in symbols
    hits = search.search_text(own.files.read(), own.chunks.read(), own.model, "text about widgets", k=2, roots=project.roots).collect()
    assert hits[0]["path"] == ".hidden/b.md" and hits[0]["absolute_path"] == f"{tree}/.hidden/b.md" and hits[0]["score"] > 0.3
    assert [h["path"] for h in search.search_text(own.files.read(), own.chunks.read(), own.model, "widgets", language="go").collect()] == ["d.go"] * 2
    assert search.get_chunk(own.files.read(), own.chunks.read(), hits[0]["chunk_id"])["symbol"] == "Title"
    with pytest.raises(KeyError):
        search.get_chunk(own.files.read(), own.chunks.read(), -1)
    with pytest.raises(ValueError):
        search.search_text(own.files.read(), own.chunks.read(), own.model, " ")
    full = own.rebuild(project)
    assert full["indexed"] == 3 and own.status()["files"] == 3 and own.status()["last_sweep"]["fullRebuild"]
    with own.lock(), pytest.raises(index.Busy):
        own.sweep(project)
    os.rename(tree, str(tree) + "-away")
    gone = own.sweep(project)
    assert gone["deleted"] == 0 and gone["errored"] == 1 and own.files.read().count() == 3
    with pytest.raises(ValueError, match="dimension"):
        index.Index(spark, str(tmp_path / "index"), "demo", model=HashingEmbedder(16)).sweep(project)
    assert own.delete_repo("repo") == 3 and own.chunks.read().count() == 0
    with pytest.raises(ValueError):
        index.Index(spark, "/x", "Bad Name")


def test_catalog(spark, tree, tmp_path):
    projects = config.Projects.of({"projects": [{"name": "one", "roots": [str(tree)]}, {"name": "lost", "roots": [str(tmp_path / "none")]}]})
    settings = config.Settings(dimension=8)
    catalog = index.Catalog(spark, str(tmp_path / "i"), projects, settings)
    assert catalog.never_scanned() == ["one", "lost"]
    swept = catalog.sweep_all()
    assert swept["one"]["indexed"] == 3 and swept["lost"]["errored"] == 1
    other = index.Catalog(spark, str(tmp_path / "i"), config.Projects.of({"projects": [{"name": "one", "roots": [str(tmp_path / "new")]}, {"name": "three", "roots": ["/r"]}]}), settings)
    plan = [(r["action"], r["project"], r["repo"], r["n_files"]) for r in other.reconcile()]
    assert plan == [("add_repo", "one", "new", 0), ("create", "three", None, 0), ("delete_repo", "one", "repo", 3), ("drop", "lost", None, 0)]
    other.reconcile(execute=True)
    assert other.index("one").files.read().count() == 0 and "lost" not in other.stored() and "three" in other.stored()


def test_store_and_records(spark, tmp_path):
    store = SnapshotTable(spark, str(tmp_path / "t"), "id int, name string, paid double", keep=2)
    assert store.version == 0 and store.read().count() == 0
    db = Database(spark)
    db.attach("people", store, ["id"])
    db.new_record("people").set("ID", 1).set("Name", "Ann").add()
    assert db.new_record("people").set("name", "Bo").add_auto() == 2
    assert db.fetch_all_json("SELECT * FROM people ORDER BY id") == [{"id": 1, "name": "Ann", "paid": None}, {"id": 2, "name": "Bo", "paid": None}]
    record = db.record("people", "SELECT * FROM people WHERE id = ?", 1)
    assert not record.update() and record.get_int("id") == 1 and record.get_string("NAME") == "Ann"
    with pytest.raises(TypeError):
        record.get_int("name")
    with pytest.raises(KeyError):
        record.get("nothing")
    record["paid"] = 2.5
    assert record.changed == {"paid": 2.5} and record.update()
    dropped = []
    db.delete_callback = lambda table, key: dropped.append((table, key))
    db.record("people", "SELECT * FROM people WHERE id = 2").delete()
    assert dropped == [("people", 2)] and [tuple(r) for r in store.read().collect()] == [(1, "Ann", 2.5)]
    store.upsert(spark.createDataFrame([(1, "Eve"), (3, "Flo")], "id int, name string"), ["id"])
    assert sorted(tuple(r) for r in store.read().collect()) == [(1, "Eve", None), (3, "Flo", None)]
    assert len(store.versions()) == 2 and store.read(store.versions()[0]).count() == 1
    assert db.fetch_one("SELECT * FROM people WHERE id = ?", 99) is None and not db.exists("SELECT 1 FROM people WHERE false")
    assert db.fetch_one_json("SELECT 1 AS a", into={"b": 2}) == {"a": 1, "b": 2} and len(list(db.cursor("SELECT * FROM people", limit=1))) == 1
    assert db.columns("people")["paid"] == "double" and db.primary_columns("PEOPLE") == ["id"]
    store.drop()
    assert store.version == 0


def test_changes_touch_their_buckets_only(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "k long, v string", keys=["k"], buckets=8, keep=2)
    table.write(spark.range(100).selectExpr("id AS k", "'old' AS v"))
    before = table._manifest(table.version)
    table.upsert(spark.createDataFrame([(3, "new")], "k long, v string"), ["k"])
    after = table._manifest(table.version)
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert table.read().count() == 100 and table.read().filter("v = 'new'").count() == 1
    table.delete(spark.createDataFrame([(3,), (4,)], "k long"))
    assert table.read().count() == 98 and table.read(table.versions()[0]).count() == 100
    for k in range(20):
        table.append(spark.createDataFrame([(1000 + k, "more")], "k long, v string"))
    assert table.read().count() == 118 and max(map(len, table._manifest(table.version).values())) <= 17
    folders = {f.split("/")[0] for v in table.versions() for fs in table._manifest(v).values() for f in fs}
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} >= folders and len(table.versions()) == 2
    table.merge(spark.createDataFrame([("more",)], "v string"), None)
    assert table.read().count() == 98
    table._commit(table._manifest(table.version), table.version)
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit({}, table.version - 1)


def test_delimited(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('Name,Qty,When\n" a ""b"" ",3,8/29/2023\n\n,,\n"x\ny",oops,bad\n')
    df = delimited.read_delimited(spark, str(path))
    assert df.columns == ["name", "qty", "when"] and delimited.missing_headers(df, ["Qty", "Z"]) == ["Z"]
    rows = df.select("name", delimited.as_int(df, "QTY").alias("q"), delimited.as_date(df, "when").alias("d"), delimited.as_double(df, "none").alias("n")).collect()
    assert sorted((r["name"], r["q"], r["d"], r["n"]) for r in rows) == [('a "b"', 3, 20230829, 0.0), ("x\ny", 0, 0, 0.0)]
    delimited.write_delimited(df.select("name", "qty"), str(tmp_path / "out"), gather=True)
    assert sorted(tuple(r) for r in delimited.read_delimited(spark, str(tmp_path / "out")).collect()) == [('a "b"', "3"), ("x\ny", "oops")]
    bare = delimited.read_delimited(spark, str(path), header=False, columns=["a", "b", "c"])
    assert bare.filter("a = 'Name'").count() == 1
    assert spark.range(1).select(delimited.field(F.lit("a|b"), "|")).first()[0] == '"a|b"' and spark.range(1).select(delimited.field(F.lit("abcd"), limit=2)).first()[0] == "ab"


def test_stream_upserts(spark, tmp_path):
    schema = "k int, v string, at int"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], schema).write.parquet(source)
    table = SnapshotTable(spark, str(tmp_path / "t"), schema)
    run = lambda: sweep.upsert_stream(sweep.read_stream(spark, source, schema), table, ["k"], "at", str(tmp_path / "cp")).awaitTermination(60)
    run()
    spark.createDataFrame([(2, "d", 5), (3, "e", 1)], schema).write.mode("append").parquet(source)
    run()
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "b", 2), (2, "d", 5), (3, "e", 1)]


def test_search_helpers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(search.score(F.lit(float("nan")))) == 0 and get(search.score(F.lit(-0.0125))) == -0.012
    assert get(search.snippet(F.lit("x" * 301))) == "x" * 300 + "..." and get(search.snippet(F.lit(None).cast("string"))) == ""
    assert [get(search.windows_path(F.lit(p), "U")) for p in ("/mnt/c/x/y", "/mnt/c", "/home/a", "rel/x")] == ["C:\\x\\y", "C:\\", "\\\\wsl$\\U\\home\\a", "rel/x"]
    assert get(search.absolute_path(F.lit("r"), F.lit("p"), ["/a/r", "/b/r/"])) == "/b/r/p" and get(search.absolute_path(F.lit("q"), F.lit("p"), [])) == "p"
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    assert [r["chunk_id"] for r in search.top_k(vectors, [1.0, 0.0], 4).collect()] == [2, 3, 4, 1]
    assert [search.clamped(k) for k in (None, 0, 99, 7)] == [8, 1, 50, 7]
