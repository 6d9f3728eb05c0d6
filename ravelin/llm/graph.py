"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import forget, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its neighbours (only the larger ones if large, else the smaller) its smallest one."""
    ab, ba = edges.select("a", "b"), edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    around = ab.unionByName(ba) if large else ab.where("b < a").unionByName(ba.where("b < a"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = around.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b) with at least one other neighbour; root is the least node.

    Self-links, repeats and both directions are allowed; nulls are left out. The shuffles are keyed by
    node and reduce by min first. Each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    one = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = stored(one, "links"), None
    for _ in range(rounds):
        nxt = stored(_star(_star(now, True).where("a <> b").distinct(), False).where("a <> b").distinct(), "links")
        mark = nxt.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        forget(spark, now)
        now = nxt
        if (mark.n, mark.s) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = (mark.n, mark.s)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
