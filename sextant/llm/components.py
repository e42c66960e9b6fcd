"""Connected components of a large graph, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.base import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Join each vertex's larger neighbours to its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join each vertex and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of every vertex of ``edges`` (columns a and b) that is not the
    smallest of its component, ``root`` being that one.  Each round is written to
    shared storage; neighbours meet in aggregations and joins, never in one row."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = written(now, "edges")
    mark = None
    for _ in range(rounds):
        now = written(_small_star(_large_star(now)), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if seen == mark:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        mark = seen
    raise RuntimeError("components did not settle")
