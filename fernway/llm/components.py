"""Connected components of an edge table by alternating large and small stars, all of it in shuffles.

In a component of many nodes, a star's centre has nearly all of them as neighbours. Its smallest neighbour is therefore found by an
aggregation with partial sums, and goes back to the edges of centres with many neighbours by broadcast, to the others by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernway.operators.rounds import cut

#: A node has many neighbours if it has more than this and more than one of ``SHARE`` of all edges, which at most 2 * ``SHARE`` nodes can have.
MANY, SHARE = 64, 10_000


def _with_least(edges: DataFrame, n_edges: int) -> DataFrame:
    """The edges (u, v) with ``m``, the least v of each u."""
    limit = max(MANY, n_edges // SHARE)
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    many = F.broadcast(least.where(F.col("n") > limit).drop("n"))
    few = least.where(F.col("n") <= limit).drop("n")
    return edges.join(many, "u").unionByName(edges.join(many.select("u"), "u", "left_anti").join(few, "u"))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node's larger neighbours, linked to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_least(both, 2 * n_edges).withColumn("m", F.least("u", "m"))
    return found.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node and its smaller neighbours, linked to the smallest of them."""
    linked = _with_least(edges, n_edges).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
    return linked.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots: the smallest node that can be reached.

    Loops are ignored; no edges give no rows. A round has two stars, each checkpointed; only its count and a checksum reach the
    driver. The rounds grow with the logarithm of the longest path.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        last, mark = mark, tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark[0] == 0 or mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = cut(_small_star(cut(_large_star(now, mark[0])), mark[0]))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
