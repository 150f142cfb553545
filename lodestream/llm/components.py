"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation and a join over the edges, so no task holds a component and no hub's neighbours are gathered.  What is joined is
written to the shared folder first: that cuts the lineage, survives lost executors, and leaves the join two plain shuffles, of which adaptive
execution can split the rows of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``u, root`` for every node with an edge to a smaller one: ``root`` is the smallest node of its component.

    ``edges`` has long columns ``u, v``; roots themselves have no row.  Loops and repeated edges are allowed.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if state[0] == 0:
            return now.select("u", F.col("v").alias("root"))
        # large star: every larger neighbour of u moves to the smallest node around u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # small star: u and its smaller neighbours move to the smallest of them
        lower = written(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        moved = large.join(lower, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(moved.union(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state, now = state, _state(after), after
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select("u", F.col("v").alias("root"))
