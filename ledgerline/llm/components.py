"""Connected components by alternating stars, all in joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Replace the edges of every vertex by edges to its least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a")
    out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every vertex of ``edges`` (``a, b``): the least vertex it reaches.

    Large and small stars in turn, until nothing changes: the number of rounds
    grows with the logarithm of the longest path.  Each round is written to the
    shared folder.  Loops and repeated edges do no harm; nulls are left out.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        now = staged(_star(_star(now, True), False), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    # every vertex now points at the least of its component
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
