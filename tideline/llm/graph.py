"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans.scratch import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node reachable.

    Alternates "large star" and "small star" rewrites: a node's larger, then smaller
    neighbours are hung on its least neighbour, until only stars are left. A round is a
    pre-aggregated minimum and a join; a hub's edges are split by the skew join. Every
    round is written to the shared folder. No edges: no rows.
    """
    e = stored(_directed(edges), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(hung.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        was, mark = mark, _mark(now)
        drop(e)
        e = now
        if was == mark:
            break
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(e: DataFrame) -> tuple:
    """Count and an order-free hash: equal marks mean the round changed nothing."""
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
