"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmframe.llm.store import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b: long): root is the least node that it reaches.

    Alternates the large star and the small star (Kiveris et al. 2014) until the
    edges make stars; rounds grow with the logarithm of a component's size.
    Each round is a partial aggregate and a join back, written to shared storage, so
    hot nodes are combined before the shuffle or split by the join.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, materialize(least.select("a", F.col("m").alias("b")).unionByName(moved).distinct())
        release(before, large)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a: then all components are done."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()
