"""The tables of the test data and how they relate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .access import Database
from .graph import RelationGraph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def sample_graph() -> RelationGraph:
    graph = RelationGraph()
    for table in TABLES:
        graph.add_table(table)
    for own, column, far, key in (
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("labels", "doc_id", "documents", "doc_id"),
    ):
        graph.add_foreign_key(own, column, far, key)
    return graph


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores, dealt out: for steps whose work on a row outweighs moving it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def database(spark: SparkSession, sf_dir: str, *tables: str) -> Database:
    """The named tables as views of the session, with their relations."""
    for name in tables or TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
    return Database(spark, sample_graph(), {"orders": ["o_orderkey"], "customer": ["c_custkey"], "lineitem": ["l_orderkey", "l_linenumber"]})
