"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges to smaller nodes are stars: no node has two centres, or is one and has one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up + down > 1").take(1)


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node, root`` of every node with an edge; the root is its component's least node.

    ``edges`` has 64-bit columns ``a, b`` and is read more than once. Only per-node minima
    are aggregated, so a hub of any degree is no group in memory. Rounds grow with the
    logarithm of the longest path; each is written to the shared folder. With ``known``,
    an earlier result, ``edges`` are those that came since: they join its roots.
    """
    if known is not None:
        for end in ("a", "b"):
            edges = edges.join(known.toDF(end, "r"), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
        more = components(written(edges.filter("a <> b").select("a", "b").distinct(), "cc-edges"))
        moved = known.join(more.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        return written(moved.unionByName(more.join(known, "node", "left_anti")), "cc-roots")
    edges = edges.filter("a <> b").select("a", "b")
    while True:
        edges = written(_small_star(_large_star(edges)), "cc-edges")
        if _settled(edges):
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
