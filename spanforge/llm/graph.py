"""Connected components by alternating large and small stars, all of it joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm._shared import Scratch

MOST_ROUNDS = 40


#: Rows of one node beyond which it meets them by a broadcast, and nodes that may be so many: the bound grows with the table.
MANY_ROWS, MOST_MANY = 100, 50_000


def _with_least(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows(u, v) with m, the least v of each u.

    The minimum is combined before the shuffle. A node with very many rows would bring them all to one task of the join back;
    such nodes, at most MOST_MANY by the way their bound is set, are broadcast instead and their rows stay where they are.
    """
    many = max(MANY_ROWS, n_rows // MOST_MANY)
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs, others = F.broadcast(least.where(F.col("n") > many).select("u", "m")), least.where(F.col("n") <= many).select("u", "m")
    return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(others, "u"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that edges(u, v) join to another: component is the least node that can be reached.

    Edges may repeat, run either way, join a node to itself or hold nulls (both without effect).
    No edge list, component or label ever comes to the driver; only counts do. What a round makes is written to
    the shared folder, so that a lost executor costs one round.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        # Large star: what is above u goes to the least of u's neighbourhood.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        n = now.count()
        large = scratch.written(_with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")), "large")
        # Small star: u and what is below it go to the least of these.
        small = _with_least(large, n).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        nxt = scratch.written(small.where("u > v").distinct(), "edges")
        # Done once no root is itself below another node, and each node has one root.
        again = nxt.groupBy("u").agg(F.count("*").alias("n"))
        loose = again.where("n > 1").count() or nxt.select(F.col("v").alias("u")).distinct().join(again, "u", "left_semi").count()
        now = nxt
        scratch.forget(1)
        if not loose:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
