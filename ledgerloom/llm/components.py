"""Connected components of links by alternating large and small stars, as DataFrame jobs.

Each round joins every node with the smallest of its neighbourhood; the number of rounds grows with
the logarithm of the longest chain.  Rounds are written tables, so a lost executor costs its tasks
only.  Links of a node with itself and repeated links don't matter; null ends are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked with; only nodes with a link to a smaller one."""
    edges = (links.where(F.col(left) != F.col(right))
             .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct())
    edges = materialize(edges, "links")
    state = _state(edges)
    while state[0]:
        edges = materialize(_small_star(materialize(_large_star(edges), "large-star")), "small-star")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
