"""Connected components of a large edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, delete


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).where("a != b").distinct()


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the smallest node that it reaches.

    Self-loops, repeated edges and either direction are fine; edges with a
    null end are dropped.  Roots themselves have no row.  Each round is
    written to the shared folder, so lost executors cost one round at most, and
    takes the table of the round before away.  Every round but the last
    moves a node to a smaller one, so the rounds end; their number grows with the
    square of the logarithm of the nodes at most.
    """
    now = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen, new = None, mark(now)
    while new[0] and new != seen:
        old = scratch.last
        now, seen = scratch.keep(_small_star(_large_star(now))), new
        new = mark(now)
        delete(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
