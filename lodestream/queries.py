"""Registered queries over the sample tables, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, jsons, markup, numbers, registry, strings
from .operators import ann, chunking, embedding, index, search
from .plans.builder import QueryBuilder
from .plans.catalog import database, dealt, load, sample_graph
from .session import dropped_at_exit, scratch_path
from .sources import delimited, languages
from .sources.store import SnapshotTable
from .streaming import sweep

Query = Callable[[SparkSession, str], DataFrame]


class Registered(NamedTuple):
    run: Query
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        REGISTRY[name or f.__name__] = Registered(f, sql)
        return f

    return add


# --- vector search

_SIM = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return [float(x) for x in load(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]]


@query(f"SELECT e.vec_id, floor({_SIM} * 1000 + 0.5) / 1000 AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_SIM} DESC, e.vec_id LIMIT 8")
def vec_topk(spark, sf_dir):
    best = search.top_k(load(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir, 0), 8, id_col="vec_id")
    return best.select("vec_id", search.score(F.col("sim")).alias("score"))


@query(f"SELECT e.vec_id, e.label, floor({_SIM} * 1000 + 0.5) / 1000 AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE e.label = 3 ORDER BY {_SIM} DESC, e.vec_id LIMIT 50")
def vec_topk_filter(spark, sf_dir):
    best = search.top_k(load(spark, sf_dir, "embeddings").filter("label = 3"), _query_vector(spark, sf_dir, 5), search.clamped(70), id_col="vec_id")
    return best.select("vec_id", "label", search.score(F.col("sim")).alias("score"))


@query(f"SELECT e.vec_id, floor({_SIM} * 1000 + 0.5) / 1000 AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q")
def vec_scores(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", search.score(search.cosine(F.col("embedding"), _query_vector(spark, sf_dir, 1))).alias("score"))


@query("SELECT vec_id, len(embedding) AS dimension, label FROM embeddings")
def vec_dimensions(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dimension"), "label")


# --- query builder: the text that it makes is its own SQL, so that another engine checks the plan


def _built(name: str, make: Callable[[QueryBuilder], QueryBuilder], *tables: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(database(spark, sf_dir, *tables).query_builder()).to_dataframe()

    REGISTRY[name] = Registered(run, sql)


def _new() -> QueryBuilder:
    return QueryBuilder(sample_graph())


_built("qb_select_where", lambda q: q.select("customer.c_custkey", "customer.c_name").where("customer.c_mktsegment = ?", "BUILDING").where("customer.c_acctbal > ?", 1000.0), "customer", sql="SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000.0")
_built("qb_or_group", lambda q: q.select("customer.c_custkey").where("customer.c_acctbal > ?", 0.0).start_or().where("customer.c_mktsegment = ?", "BUILDING").start_and().where("customer.c_mktsegment = ?", "MACHINERY").where("customer.c_nationkey < ?", 10).end_and().end_or(), "customer", sql="SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND (c_mktsegment = 'BUILDING' OR (c_mktsegment = 'MACHINERY' AND c_nationkey < 10))")
_built("qb_distinct", lambda q: q.select("customer.c_mktsegment").distinct(), "customer", sql="SELECT DISTINCT c_mktsegment FROM customer")
_built("qb_alias", lambda q: q.alias("customer", "c").alias("nation", "n").select("c.c_name", "n.n_name").where("n.n_nationkey = ?", 3), "customer", "nation", sql="SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 3")
_built("qb_autojoin_2", lambda q: q.select("customer.c_name", "nation.n_name").where("nation.n_name LIKE ?", "%A%"), "customer", "nation", sql="SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name LIKE '%A%'")
_built("qb_autojoin_hops", lambda q: q.select("orders.o_orderkey", "region.r_name").where("orders.o_totalprice > ?", 100000.0), "orders", "customer", "nation", "region", sql="SELECT o_orderkey, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 100000.0")
_built("qb_autojoin_ambiguous", lambda q: q.select("nation.n_name").select_count("lineitem.l_orderkey", "n").where("lineitem.l_quantity > ?", 30.0).group_by("nation.n_name"), "lineitem", "supplier", "nation", sql="SELECT n_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 30 GROUP BY n_name")
_built("qb_autojoin_star", lambda q: q.select("part.p_brand", "supplier.s_name", "ROUND(SUM(lineitem.l_extendedprice), 2) AS total").where("orders.o_orderstatus = ?", "F").group_by("part.p_brand", "supplier.s_name"), "lineitem", "part", "supplier", "orders", sql="SELECT p_brand, s_name, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderstatus = 'F' GROUP BY p_brand, s_name")
_built("qb_left", lambda q: q.select("customer.c_custkey", "orders.o_orderkey").left_join("orders").where("customer.c_nationkey = ?", 7), "customer", "orders", sql="SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7")
_built("qb_right", lambda q: q.select("orders.o_orderkey", "customer.c_custkey").right_join("customer"), "customer", "orders", sql="SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
_built("qb_explicit_join", lambda q: q.select("orders.o_orderkey", "customer.c_name").join("orders", "o_custkey", "customer", "c_custkey"), "orders", "customer", sql="SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_built("qb_explicit_left", lambda q: q.select("customer.c_custkey", "orders.o_orderkey").left_join("customer", "c_custkey", "orders", "o_custkey"), "customer", "orders", sql="SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
_built("qb_explicit_right", lambda q: q.select("part.p_partkey", "supplier.s_suppkey").right_join("part", "p_partkey", "supplier", "s_suppkey").where("supplier.s_suppkey > ?", 0), "supplier", "part", sql="SELECT p_partkey, s_suppkey FROM part RIGHT JOIN supplier ON p_partkey = s_suppkey WHERE s_suppkey > 0")
_built("qb_left_alias", lambda q: q.select("nation.n_name", "other.n_name AS neighbour").left_join("nation", ["n_regionkey", "n_nationkey"], "nation", ["n_regionkey", "n_nationkey"], "other"), "nation", sql="SELECT a.n_name, b.n_name AS neighbour FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey = b.n_nationkey")
_built("qb_right_alias", lambda q: q.select("customer.c_name", "home.n_name AS home").right_join("customer", "c_nationkey", "nation", "n_nationkey", "home"), "customer", "nation", sql="SELECT c_name, n_name AS home FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey")
_built("qb_self_join", lambda q: q.select("nation.n_name", "other.n_name AS neighbour").join("nation", "n_regionkey", "nation", "n_regionkey", "other").where("nation.n_nationkey < ?", 5), "nation", sql="SELECT a.n_name, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < 5")
_built("qb_composite", lambda q: q.select("lineitem.l_orderkey", "again.l_quantity AS quantity").join("lineitem", ["l_orderkey", "l_linenumber"], "lineitem", ["l_orderkey", "l_linenumber"], "again").where("lineitem.l_tax < ?", 0.02), "lineitem", sql="SELECT a.l_orderkey, b.l_quantity AS quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_tax < 0.02")
_built("qb_in", lambda q: q.select("customer.c_custkey").where_in("customer.c_custkey", _new().select("orders.o_custkey").where("orders.o_totalprice > ?", 300000.0)), "customer", "orders", sql="SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000.0)")
_built("qb_not_in", lambda q: q.select("customer.c_custkey").where_not_in("customer.c_custkey", "SELECT o_custkey FROM orders WHERE o_totalprice > ?", 400000.0), "customer", "orders", sql="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000.0)")
_built("qb_exists", lambda q: q.select("customer.c_custkey").where_exists("SELECT 1 FROM orders o WHERE o.o_custkey = customer.c_custkey AND o.o_orderstatus = ?", "P"), "customer", "orders", sql="SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = customer.c_custkey AND o.o_orderstatus = 'P')")
_built("qb_not_exists", lambda q: q.select("customer.c_custkey").where_not_exists("SELECT 1 FROM orders o WHERE o.o_custkey = customer.c_custkey AND o.o_orderstatus = ?", "P"), "customer", "orders", sql="SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = customer.c_custkey AND o.o_orderstatus = 'P')")
_built("qb_exists_builder", lambda q: q.select("nation.n_name").where_exists(_new().select("region.r_name").where("region.r_regionkey = ?", 1)), "nation", "region", sql="SELECT n_name FROM nation WHERE EXISTS (SELECT r_name FROM region WHERE r_regionkey = 1)")
for _f in ("count", "sum", "avg", "min", "max"):
    _built(f"qb_{_f}", lambda q, f=_f: getattr(q.select("lineitem.l_returnflag"), f"select_{f}")("lineitem.l_quantity", "value").group_by("lineitem.l_returnflag"), "lineitem", sql=f"SELECT l_returnflag, {_f}(l_quantity) AS value FROM lineitem GROUP BY l_returnflag")
_built("qb_having", lambda q: q.select("orders.o_custkey").select_count("orders.o_orderkey", "n").group_by("orders.o_custkey").having("COUNT(orders.o_orderkey) > ?", 15), "orders", sql="SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
_built("qb_cte_raw", lambda q: q.with_("big", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > ? GROUP BY o_custkey", 200000.0).select("big.o_custkey", "big.n"), "orders", sql="SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000.0 GROUP BY o_custkey")
_built("qb_cte_builder", lambda q: q.with_("rich", _new().select("customer.c_custkey", "customer.c_nationkey").where("customer.c_acctbal > ?", 9000.0)).select("rich.c_nationkey", "COUNT(*) AS n").group_by("rich.c_nationkey"), "customer", sql="SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000.0 GROUP BY c_nationkey")
_built("qb_union", lambda q: q.select("customer.c_nationkey AS k").union(_new().select("supplier.s_nationkey AS k")), "customer", "supplier", sql="SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_built("qb_union_all", lambda q: q.select("customer.c_nationkey AS k").where("customer.c_acctbal > ?", 5000.0).union_all(_new().select("supplier.s_nationkey AS k").where("supplier.s_acctbal > ?", 5000.0)), "customer", "supplier", sql="SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000.0 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000.0")
_built("qb_order_limit", lambda q: q.select("orders.o_orderkey", "orders.o_totalprice").order_by_desc("orders.o_totalprice").order_by("orders.o_orderkey").limit(25), "orders", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey NULLS LAST LIMIT 25")


# --- access


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200")
def page_2(spark, sf_dir):
    return database(spark, sf_dir, "orders").page(2, 100, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey")


@query("SELECT count(*) AS n, CAST(count(*) > 0 AS BOOLEAN) AS found FROM orders WHERE o_orderstatus = 'O'")
def fetch_count(spark, sf_dir):
    db = database(spark, sf_dir, "orders")
    text = "SELECT * FROM orders WHERE o_orderstatus = ?"
    return spark.createDataFrame([(db.fetch_count(text, "O"), db.exists(text, "O"))], "n long, found boolean")


@query("SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders")
def sql_pass_through(spark, sf_dir):
    return database(spark, sf_dir, "orders").sql("SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders")


# --- index metadata and sweeps


def _files(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("lang").alias("language"), F.col("doc_id").alias("file_id"), F.lit("2024-01-01").cast("timestamp").alias("indexed_at")
    )


@query("SELECT source AS repo, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def list_repos(spark, sf_dir):
    return search.list_repos(_files(spark, sf_dir))


_WINDOWS = """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> ''),
    w AS (SELECT doc_id, x, unnest(range(0, CASE WHEN len(x) <= 60 THEN 1 ELSE CAST(ceil((len(x) - 60) / 50.0) AS BIGINT) + 1 END)) AS k FROM l),
    c AS (SELECT doc_id, k, x, array_to_string(x[k * 50 + 1:k * 50 + 60], chr(10)) AS content FROM w)
"""


def _chunks(spark, sf_dir) -> DataFrame:
    made = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.line_windows(F.col("text"))).alias("chunk_no", "c"))
    return made.select("doc_id", "chunk_no", "c.start_line", "c.end_line", "c.content")


@query(_WINDOWS + "SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM c WHERE regexp_matches(content, '[^\\x00-\\x20]')) AS chunks, (SELECT TIMESTAMP '2024-01-01' + to_seconds(max(doc_id)) FROM documents) AS last_indexed_at")
def index_status(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("indexed_at", F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("file_id")))
    return search.index_status(files, _chunks(spark, sf_dir))


@query("""
    WITH old AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE source <> 'src2'),
    new AS (SELECT doc_id, sha256(CASE WHEN lang = 'es' THEN text || '!' ELSE text END) AS sha FROM documents WHERE lang <> 'de')
    SELECT doc_id, CASE WHEN new.sha IS NULL THEN 'delete' WHEN old.sha IS NULL THEN 'insert' WHEN old.sha = new.sha THEN 'unchanged' ELSE 'update' END AS action
    FROM old FULL JOIN new USING (doc_id)
""")
def sweep_actions(spark, sf_dir):
    """The comparison of two states of a corpus: one source came in, one language went away and another one was edited."""
    docs = load(spark, sf_dir, "documents")
    key = [F.lit("r").alias("repo"), F.col("doc_id").cast("string").alias("path")]
    edited = F.when(F.col("lang") == "es", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.filter("source <> 'src2'").select(*key, F.sha2("text", 256).alias("sha256"))
    new = docs.filter("lang <> 'de'").select(*key, F.sha2(edited, 256).alias("sha256"))
    return index.actions(old, new).select(F.col("path").cast("long").alias("doc_id"), "action")


@query("""
    WITH stored AS (SELECT source AS project, lang AS repo, CAST(count(*) AS BIGINT) AS n_files FROM documents GROUP BY ALL)
    SELECT 'drop' AS action, project, NULL AS repo, CAST(sum(n_files) AS BIGINT) AS n_files FROM stored WHERE project = 'src1' GROUP BY project
    UNION ALL SELECT 'create', 'new', NULL, 0
    UNION ALL SELECT 'delete_repo', project, repo, n_files FROM stored WHERE project = 'src2' AND repo = 'de'
    UNION ALL SELECT 'add_repo', project, 'xx', 0 FROM stored WHERE project = 'src3' GROUP BY project
""")
def reconcile(spark, sf_dir):
    """A project that is no longer configured, a new one, a repository that went away and one that came."""
    stored = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("project"), F.col("lang").alias("repo")).agg(F.count("*").alias("n_files"))
    kept = stored.filter("project <> 'src1' and not (project = 'src2' and repo = 'de')").select("project", "repo")
    configured = kept.union(spark.createDataFrame([("new", "a"), ("new", "b"), ("src3", "xx")], kept.schema))
    return index.reconcile_plan(configured, stored).select("project", "repo", "n_files", "action")


# --- chunks


@query("""
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> ''),
    w AS (SELECT doc_id, x, unnest(range(0, CASE WHEN len(x) <= 60 THEN 1 ELSE CAST(ceil((len(x) - 60) / 50.0) AS BIGINT) + 1 END)) AS k FROM l)
    SELECT doc_id, CAST(k * 50 + 1 AS INT) AS start_line, CAST(least(k * 50 + 60, len(x)) AS INT) AS end_line, sha256(array_to_string(x[k * 50 + 1:k * 50 + 60], chr(10))) AS content_sha
    FROM w WHERE regexp_matches(array_to_string(x[k * 50 + 1:k * 50 + 60], chr(10)), '[^\\x00-\\x20]')
""")
def chunk_windows(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    made = docs.select("doc_id", F.explode(chunking.line_windows(F.col("text"))).alias("c"))
    return made.select("doc_id", "c.start_line", "c.end_line", F.sha2("c.content", 256).alias("content_sha"))


@query()
def chunk_documents(spark, sf_dir):
    docs = dealt(load(spark, sf_dir, "documents")).select("doc_id", F.col("text").alias("content"), F.lit("markdown").alias("language"))
    made = chunking.chunked(docs, "doc_id")
    return made.select("doc_id", "chunk_no", "start_line", "end_line", "symbol", F.sha2("content", 256).alias("content_sha"), "token_est")


@query("SELECT doc_id, CAST(greatest(1, floor((length(text) + length(regexp_replace(text, '[\\x{0}-\\x{FFFF}]', '', 'g'))) / 4)) AS INT) AS token_est FROM documents")
def chunk_tokens(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", chunking.token_estimate(F.col("text")).alias("token_est"))


@query()
def embed_documents(spark, sf_dir):
    docs = dealt(load(spark, sf_dir, "documents")).select("doc_id", "text")
    vectors = embedding.embedded(docs, embedding.HashingEmbedder(64), text_col="text")
    return vectors.select("doc_id", F.sha2(embedding.literal(F.col("embedding")), 256).alias("vector_sha"))


# --- dates


_D = "CAST(strftime(o_orderdate, '%Y%m%d') AS INT)"


@query(f"SELECT o_orderkey, {_D} AS d, CAST(strftime(o_orderdate + INTERVAL 45 DAY, '%Y%m%d') AS INT) AS plus_days, CAST(strftime(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH, '%Y%m%d') AS INT) AS plus_months, {_D} + 20000 AS plus_years, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS since, CAST(dayofweek(o_orderdate) AS INT) AS weekday, CAST(date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 AS INT) AS day_number FROM orders")
def date_arithmetic(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", dates.to_int("o_orderdate").alias("d"))
    return o.select("o_orderkey", "d", dates.add_days("d", 45).alias("plus_days"), dates.add_months("d", 3).alias("plus_months"), dates.add_years("d", 2).alias("plus_years"), dates.days_between("d", F.lit(19950101)).alias("since"), dates.day_of_week("d").alias("weekday"), dates.julian("d").alias("day_number"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%-m/%-d/%y') AS short, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%b %-d, %Y') AS long, strftime(o_orderdate, '%a, %b %-d, %Y') AS full_form, strftime(o_orderdate, '%A') AS weekday, strftime(o_orderdate, '%B') AS month FROM orders")
def date_formats(spark, sf_dir):
    d = dates.to_int("o_orderdate")
    forms = {"short": dates.SHORT, "iso": dates.ISO, "long": dates.LONG, "full_form": dates.LONG_WITH_DAY}
    return load(spark, sf_dir, "orders").select("o_orderkey", *[dates.format_date(d, p).alias(n) for n, p in forms.items()], dates.day_name(d).alias("weekday"), dates.month_name(d).alias("month"))


@query(f"SELECT o_orderkey, {_D} AS from_iso, {_D} AS from_us, {_D} AS from_dots, 0 AS from_junk, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, {_D} AS back FROM orders")
def date_parse(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    p = lambda pattern: dates.parse_date(F.date_format("o_orderdate", pattern))
    d = dates.to_int("o_orderdate")
    return o.select("o_orderkey", p("yyyy-M-d").alias("from_iso"), p("M/d/yyyy").alias("from_us"), p("M.d.yyyy").alias("from_dots"), dates.parse_date(F.lit("no date")).alias("from_junk"), dates.year(d).alias("y"), dates.month(d).alias("m"), dates.day(d).alias("d"), dates.calendar(dates.julian(d)).alias("back"))


@query("SELECT event_id, CAST(strftime(ts, '%Y%m%d%H%M') AS BIGINT) AS n, CAST(strftime(ts + INTERVAL 90 MINUTE, '%Y%m%d%H%M') AS BIGINT) AS later, CAST(strftime(ts + INTERVAL 1 MONTH, '%Y%m%d%H%M') AS BIGINT) AS next_month, CAST(floor(epoch(date_trunc('minute', ts)) * 1000) AS BIGINT) AS ms, strftime(ts, '%H:%M') AS military, strftime(ts, '%-I:%M %p') AS am_pm, strftime(ts, '%m/%d/%Y %-I:%M %p') AS text FROM events")
def datetime_arithmetic(spark, sf_dir):
    n = dates.number_of("ts")
    t = dates.time_of("ts")
    return load(spark, sf_dir, "events").select("event_id", n.alias("n"), dates.plus(n, mins=F.lit(90), years=F.lit(0), months=F.lit(0), days=F.lit(0), hours=F.lit(0)).alias("later"), dates.plus(n, months=F.lit(1), years=F.lit(0), days=F.lit(0), hours=F.lit(0), mins=F.lit(0)).alias("next_month"), dates.to_epoch(n, "UTC").alias("ms"), dates.military(t).alias("military"), dates.am_pm(t).alias("am_pm"), dates.format_stamp(n).alias("text"))


@query("SELECT event_id, CAST(strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y%m%d%H%M') AS BIGINT) AS local FROM events")
def datetime_zones(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", dates.from_epoch(F.unix_seconds(F.col("ts").cast("timestamp")), "America/New_York").alias("local"))


@query("SELECT event_id, CAST(strftime(ts, '%H%M') AS INT) AS from_colon, CAST(strftime(ts, '%H%M') AS INT) AS from_pm FROM events")
def time_parse(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", dates.parse_time(F.date_format("ts", "HH:mm")).alias("from_colon"), dates.parse_time(F.date_format("ts", "h:mm a")).alias("from_pm"))


# --- strings and numbers


@query("SELECT p_partkey, rpad(p_name, 8, ' ') AS take_8, right(lpad(p_name, 100, ' '), 12) AS take_last, substr(p_name, 4) AS drop_3, p_name[:greatest(length(p_name) - 2, 0)] AS drop_last, substr(p_name, 3, 4) AS sub, upper(p_brand) AS brand FROM part")
def str_take_drop(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", strings.take("p_name", 8).alias("take_8"), strings.take("p_name", -12).alias("take_last"), strings.drop("p_name", 3).alias("drop_3"), strings.drop("p_name", -2).alias("drop_last"), strings.substring("p_name", 2, 4).alias("sub"), F.upper("p_brand").alias("brand"))


@query(r"""
    SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_replace(translate(regexp_replace(html, '<br *[^>]*>', chr(10), 'g'),
        '‘’‛❛❜“‟”❝❞〝〞', '''''''''''"""""""'), '<[^>]*>', ' ', 'g'), '&sp;', ' '), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', '''') AS plain FROM pages
""")
def str_html_to_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", strings.html_to_text("html").alias("plain"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped, url AS unescaped, base64(encode(url)) AS coded, url AS decoded FROM pages")
def str_codecs(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", strings.xml_escape("url").alias("escaped"), strings.xml_unescape(strings.xml_escape("url")).alias("unescaped"), strings.base64_encode(F.col("url").cast("binary")).alias("coded"), strings.base64_decode(strings.base64_encode(F.col("url").cast("binary"))).cast("string").alias("decoded"))


@query()
def str_to_ascii(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2(strings.to_ascii("text"), 256).alias("ascii_sha"))


@query()
def str_closest_match(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", strings.closest_match("p_type", ["small steel", "large brass", "economy tin", "promo copper"]).alias("match"))


@query("SELECT l_orderkey, l_linenumber, sign(l_extendedprice) * floor(abs(l_extendedprice * 10) + 0.5) / 10 AS half_up, sign(l_extendedprice) * ceil(abs(l_extendedprice * 10)) / 10 AS up, sign(l_extendedprice) * floor(abs(l_extendedprice * 10)) / 10 AS down, CAST(floor(-l_extendedprice) AS BIGINT) AS low FROM lineitem")
def num_round(spark, sf_dir):
    p = "l_extendedprice"
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.round_half_up(p, 1).alias("half_up"), numbers.round_up(p, 1).alias("up"), numbers.round_down(p, 1).alias("down"), numbers.floor(-F.col(p)).alias("low"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS number, CAST(floor(o_totalprice) AS BIGINT) AS whole, 0 AS junk, true AS fine, false AS bad FROM orders")
def num_parse(spark, sf_dir):
    text = F.format_number(F.round("o_totalprice", 2), 2)
    whole = F.format_number(F.floor("o_totalprice"), 0)
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", numbers.parse_double(F.concat(text, F.lit(" USD"))).alias("number"), numbers.parse_long(F.concat(whole, F.lit(".0"))).alias("whole"), numbers.parse_int(F.lit("abc")).alias("junk"), numbers.is_number(text).alias("fine"), numbers.is_number(F.concat(text, F.lit("x"))).alias("bad")
    )


@query()
def num_picture(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.format_picture("l_extendedprice", "CD", 14, 2).alias("price"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS text, CAST(json_extract(props, '$.k') AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS none, true AS has_k FROM events")
def json_paths(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", jsons.get_int("props", "k").alias("k"), jsons.query("props", "/k").alias("text"), jsons.get_double("props", "k").alias("number"), jsons.get_string("props", "k.deep[2]").alias("none"), jsons.has_key("props", "k").alias("has_k"))


@query("""SELECT event_id, '{"k":' || (props->>'$.k') || ',"z":1}' AS put, '{}' AS removed, CAST(1 AS INT) AS n FROM events""")
def json_members(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", jsons.put("props", "z", F.lit("1")).alias("put"), jsons.remove("props", "k").alias("removed"), jsons.size(F.col("props")).alias("n"))


@query("""SELECT p_partkey, '{"part": {"size": ' || p_size || ', "brand": "' || p_brand || '"}}' AS as_json, '<part><size>' || p_size || '</size><brand>' || p_brand || '</brand></part>' AS back FROM part""")
def xml_and_json(spark, sf_dir):
    xml = F.concat(F.lit('<part size="'), F.col("p_size").cast("string"), F.lit('"><brand>'), strings.xml_escape("p_brand"), F.lit("</brand></part>"))
    to_json, to_xml = markup.on_batches(markup.xml_to_json), markup.on_batches(markup.json_to_xml)
    return load(spark, sf_dir, "part").select("p_partkey", to_json(xml).alias("as_json")).withColumn("back", to_xml(F.col("as_json")))


#: Names of files by the last digit of an id, and their media types.
_PAGES = ("a/b.HTML", "a/b.", "x.tar.gz", "notes", "pic.JPeG", "a.woff2", "b.3gp", "csv", "d.xlsx", "e.mjs")
_MIMES = ("text/html", markup.NO_MIME, "application/gzip", markup.NO_MIME, "image/jpeg", "font/woff2", "audio/3gpp", "text/csv", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "text/javascript")


@query("SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_MIMES)) + " END AS mime FROM pages")
def str_mime(spark, sf_dir):
    name = F.expr("CASE page_id % 10 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_PAGES)) + " END")
    return load(spark, sf_dir, "pages").select("page_id", markup.mime_type(name).alias("mime"))


@query("""
    SELECT p_partkey, p_name || ' ' AS left_side, '  ' || p_name AS right_side, p_name AS both_sides, p_type[1] AS first, array_to_string(string_split(p_type, ' '), '-') AS joined,
           CAST(len(string_split(p_type, ' ')) AS INT) AS parts, false AS empty, true AS none, printf('%05d|%s', p_size, p_brand) AS printed FROM part
""")
def str_strip_split(spark, sf_dir):
    padded = F.concat(F.lit("  "), "p_name", F.lit(" "))
    words = strings.split("p_type", " ")
    return load(spark, sf_dir, "part").select(
        "p_partkey", strings.left_strip(padded).alias("left_side"), strings.right_strip(padded).alias("right_side"), strings.strip(padded).alias("both_sides"), strings.first_char("p_type").alias("first"),
        strings.join(words, "-").alias("joined"), F.size(words).alias("parts"), strings.is_empty("p_name").alias("empty"), strings.is_empty(F.lit("")).alias("none"), strings.printf("%05d|%s", "p_size", "p_brand").alias("printed"),
    )


@query("""
    SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, CAST(strftime(ts, '%Y%m%d') AS INT) AS d, CAST(strftime(ts, '%H%M') AS INT) AS t, CAST(strftime(ts, '%Y%m%d%H%M') AS BIGINT) AS again,
           CAST(strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%Y%m%d%H%M') AS BIGINT) AS tokyo, CAST(date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts)) AS BIGINT) AS since, strftime(ts, '%Y/%m/%d %H:%M') AS shown FROM events
""")
def datetime_parts(spark, sf_dir):
    n = dates.number_of("ts")
    return load(spark, sf_dir, "events").select(
        "event_id", dates.hour(dates.time_of("ts")).alias("h"), dates.minutes(dates.time_of("ts")).alias("m"), dates.date_part(n).alias("d"), dates.time_part(n).alias("t"), dates.create(dates.date_part(n), dates.time_part(n)).alias("again"),
        dates.in_zone(n, "UTC", "Asia/Tokyo").alias("tokyo"), dates.minutes_between(n, F.lit(202401010000), "UTC").alias("since"), dates.format_stamp(n, "yyyy/MM/dd HH:mm").alias("shown"),
    )


@query("SELECT c_custkey, '[{\"name\": \"' || c_name || '\", \"segment\": \"' || c_mktsegment || '\"}]' AS as_json FROM customer")
def csv_and_json(spark, sf_dir):
    csv = F.concat(F.lit("name,segment\n"), "c_name", F.lit(","), "c_mktsegment")
    return load(spark, sf_dir, "customer").select("c_custkey", markup.on_batches(markup.csv_to_json)(csv).alias("as_json"))


@query("SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"none\":null}' AS as_json FROM nation")
def json_rows(spark, sf_dir):
    n = load(spark, sf_dir, "nation").withColumn("none", F.lit(None).cast("string"))
    return n.select("n_nationkey", jsons.row_json("n_nationkey", "n_name", "none").alias("as_json"))


@query("SELECT event_id, CAST(abs(value - 10) < 5 AS BOOLEAN) AS close, value FROM events")
def num_near(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", numbers.near(F.col("value"), F.lit(10.0), 5.0).alias("close"), "value")


@query("SELECT event_type, window_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events) GROUP BY ALL")
def event_windows(spark, sf_dir):
    return sweep.events_by_window(load(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_nationkey <> 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS nation, c_name || ',' || c_mktsegment AS line FROM customer")
def delimited_lines(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_mktsegment", delimited.no_zero(F.col("c_nationkey")).alias("nation"), delimited.line(delimited.field(F.col("c_name")), delimited.field(F.col("c_mktsegment"))).alias("line"))


#: Names of files by the last digit of an id, and what they are.
_FILES = ("a/B.Java", ".env", "x/Dockerfile", "README", "Makefile", "b.tsx", "c.py", "d.", "e.unknown", "CMakeLists.txt")
_KINDS = ("java", "ini", "dockerfile", None, "makefile", "typescript", "python", None, None, "text")


def _by_digit(values: tuple) -> str:
    return "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else f"'{v}'") for k, v in enumerate(values)) + " END"


@query(f"SELECT doc_id, {_by_digit(_KINDS)} AS language FROM documents")
def languages_of(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", languages.language(F.expr(_by_digit(_FILES))).alias("language"))


# --- what other modules offer: functions in SQL, JSON members, files, statements, search


@query("""
    SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS d, CAST(o_orderdate AS DATE) AS back, CAST(strftime(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY, '%Y%m%d') AS INT) AS later,
           rpad(left(o_orderstatus, 3), 3, ' ') AS status, sign(o_totalprice) * floor(abs(o_totalprice) * 10 + 0.5) / 10 AS price FROM orders
""")
def sql_functions(spark, sf_dir):
    registry.register(spark)
    text = "SELECT o_orderkey, date_number(CAST(o_orderdate AS DATE)) AS d, number_date(date_number(CAST(o_orderdate AS DATE))) AS back, add_days_number(date_number(CAST(o_orderdate AS DATE)), 30) AS later, take_left(o_orderstatus, 3) AS status, round_half_up(o_totalprice, 1) AS price FROM orders"
    return database(spark, sf_dir, "orders").sql(text)


@query("""
    SELECT event_id, '{"k":' || (CAST(props->>'$.k' AS BIGINT) + 5) || '}' AS raised, '{"k":' || (props->>'$.k') || ',"n":1}' AS fresh, '{"k":[' || (props->>'$.k') || ',"x"]}' AS gathered,
           '{"k":' || (props->>'$.k') || ',"tags":["x","y"]}' AS appended, true AS same, false AS other FROM events
""")
def json_counters(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    once = jsons.append("props", "tags", F.lit('"x"'))
    return e.select(
        "event_id", jsons.increment("props", "k", 5).alias("raised"), jsons.increment("props", "n").alias("fresh"), jsons.accumulate("props", "k", F.lit('"x"')).alias("gathered"),
        jsons.append(once, "tags", F.lit('"y"')).alias("appended"), jsons.equal(F.col("props"), F.concat(F.lit(" "), F.col("props"))).alias("same"), jsons.equal(F.col("props"), jsons.increment("props", "k")).alias("other"),
    )


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS balance, c_mktsegment || ', \"' || c_nationkey || '\"' AS odd, 0 AS missing FROM customer")
def delimited_round_trip(spark, sf_dir):
    """A table written as delimited text and read back: quotes, delimiters inside values, numbers from text, a column that is not there."""
    path = scratch_path(spark, "delimited")
    c = load(spark, sf_dir, "customer")
    delimited.write_delimited(c.select("c_custkey", "c_name", F.round("c_acctbal", 2).cast("decimal(18,2)").alias("Balance"), F.concat("c_mktsegment", F.lit(', "'), "c_nationkey", F.lit('"')).alias("odd")), path)
    dropped_at_exit(spark, path)
    back = delimited.read_delimited(spark, path)
    return back.select(delimited.as_int(back, "c_custkey").cast("long").alias("c_custkey"), "c_name", delimited.as_double(back, "balance").alias("balance"), "odd", delimited.as_int(back, "missing").alias("missing"))


@query("SELECT c_custkey, c_name || ',\"' || upper(c_mktsegment) || '\"' AS raw, 2 AS n_fields, upper(c_mktsegment) AS segment FROM customer")
def delimited_raw(spark, sf_dir):
    path = scratch_path(spark, "delimited-raw")
    c = load(spark, sf_dir, "customer")
    c.select(delimited.line(delimited.field(F.col("c_name")), delimited.upper_quoted(F.col("c_mktsegment"))).alias("value")).write.text(path)
    dropped_at_exit(spark, path)
    return delimited.read_raw(spark, path, ["name", "segment"], expect=2).select(F.regexp_extract("name", "([0-9]+)$", 1).cast("long").alias("c_custkey"), "raw", "n_fields", "segment")


@query("""
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus
    FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT -o_orderkey, o_custkey, 0.0, 'copy' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 0, 7, NULL, 'it''s?'
""")
def sql_statements(spark, sf_dir):
    """UPDATE, DELETE and both forms of INSERT on a versioned copy of a table."""
    db = database(spark, sf_dir, "orders")
    path = scratch_path(spark, "statements")
    store = SnapshotTable(spark, path, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string", keys=["o_orderkey"])
    store.write(load(spark, sf_dir, "orders"))
    dropped_at_exit(spark, path)
    db.attach("own_orders", store, ["o_orderkey"])
    db.execute("UPDATE own_orders SET o_totalprice = o_totalprice * ? + 1, o_orderstatus = ? WHERE o_orderstatus = ?", 2, "open", "O")
    db.execute("DELETE FROM own_orders WHERE o_orderstatus = ?", "P")
    db.execute("INSERT INTO own_orders (o_orderkey, o_custkey, o_totalprice, o_orderstatus) SELECT -o_orderkey, o_custkey, 0.0D, 'copy' FROM orders WHERE o_orderstatus = ?", "F")
    db.execute("INSERT INTO own_orders (o_orderkey, o_custkey, o_orderstatus) VALUES (?, ?, ?)", 0, 7, "it's?")
    return store.read()


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS source
    FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_custkey % 3 = 0 UNION ALL SELECT -1, 0.5, 'seed'
""")
def store_changes(spark, sf_dir):
    """Upserts by key, deletes, and a seed in which existing rows win, over buckets of a versioned table."""
    path = scratch_path(spark, "store")
    table = SnapshotTable(spark, path, "c_custkey long, c_acctbal double, source string", keys=["c_custkey"], buckets=8)
    c = load(spark, sf_dir, "customer")
    table.write(c.withColumn("source", F.lit("first")))
    dropped_at_exit(spark, path)
    table.delete(c.filter("c_mktsegment = 'BUILDING'").select("c_custkey"))
    table.upsert(c.filter("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("second").alias("source")), ["c_custkey"])
    seed = c.filter("c_mktsegment <> 'BUILDING'").select("c_custkey", F.lit(0.0).alias("c_acctbal"), F.lit("seed").alias("source"))
    table.seed(seed.union(spark.createDataFrame([(-1, 0.5, "seed")], table.schema)), ["c_custkey"])
    return table.read()


@query("""
    SELECT c_custkey, 'a' || c_custkey AS v, CAST(2 AS INT) AS at FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, 'b' || c_custkey, 3 FROM customer WHERE c_custkey % 2 = 1
""")
def stream_upserts(spark, sf_dir):
    """Two runs of a stream into a table: of each key the latest row counts, and one that comes late and is older changes nothing."""
    c = load(spark, sf_dir, "customer").select("c_custkey")
    base = scratch_path(spark, "stream")
    schema = "c_custkey long, v string, at int"
    table = SnapshotTable(spark, f"{base}/table", schema, keys=["c_custkey"], buckets=8)
    row = lambda mark, at: c.select("c_custkey", F.concat(F.lit(mark), "c_custkey").alias("v"), F.lit(at).alias("at"))
    for batch in (row("a", 2).union(row("z", 1)), row("b", 3).filter("c_custkey % 2 = 1").union(row("y", 1))):
        batch.write.mode("append").parquet(f"{base}/in")
        sweep.upsert_stream(sweep.read_stream(spark, f"{base}/in", schema), table, ["c_custkey"], "at", f"{base}/checkpoint").awaitTermination()
    dropped_at_exit(spark, base)
    return table.read()


@query(f"""
    SELECT e.vec_id AS chunk_id, d.source AS repo, 'd' || d.doc_id || '.txt' AS path, floor({_SIM} * 1000 + 0.5) / 1000 AS score,
           CASE WHEN length(d.text) > 300 THEN substr(d.text, 1, 300) || '...' ELSE d.text END AS snippet
    FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 2) q WHERE d.lang = 'en' ORDER BY {_SIM} DESC, e.vec_id LIMIT 20
""")
def search_chunks(spark, sf_dir):
    """The search tool: files filtered by language, their chunks compared, contents of the best alone looked up."""
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    chunks = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("file_id"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("string").alias("symbol"), "embedding").join(texts, "chunk_id")
    hits = search.search(_files(spark, sf_dir), chunks, _query_vector(spark, sf_dir, 2), k=20, language="en")
    return hits.select("chunk_id", "repo", "path", "score", "snippet")


@query()
def ann_topk(spark, sf_dir):
    """Approximate search over lists; a test measures its recall."""
    path = scratch_path(spark, "lists")
    lists = ann.ListIndex.build(load(spark, sf_dir, "embeddings"), path, "vec_id")
    dropped_at_exit(spark, path)
    return lists.top_k(_query_vector(spark, sf_dir, 0), 8).select("vec_id", search.score(F.col("sim")).alias("score"))


def queries() -> dict[str, Query]:
    return {name: r.run for name, r in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: r.sql for name, r in REGISTRY.items() if r.sql}
