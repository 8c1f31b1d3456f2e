"""Exact deduplication with a heavy-hitter split.

A Misra-Gries style sketch names the digests that may be frequent.  An exact
count of just these verifies them, and the winners are broadcast, so that rows
of frequent digests are decided where they are read and never travel.  All
other digests, none of them frequent, are shuffled in the ordinary way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACE, staged, whole_text

#: counters of one sketch; a digest on more than 1 / (0.75 * TRACKED) of all rows is always found
TRACKED = 1024

#: sketches are merged in this many groups before the last merge
SKETCH_GROUPS = 256


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def frequent_digests(digests: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """Digests on at least ``1 / (0.75 * tracked)`` of the rows: count and least key.

    At most ``tracked`` rows, whatever the input.  The sketch proposes, an
    exact count of the proposals decides.
    """
    sketches = (digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_part"))
                .agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("_sketch")))
    # grouped, for a global aggregate fails on tasks without rows
    proposed = (sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(_sketch, {tracked})").alias("_sketch"))
                .select(F.explode(F.expr(f"approx_top_k_estimate(_sketch, {tracked})")).alias("_found"))
                .select(F.col("_found.item").alias("digest")).filter("digest IS NOT NULL"))
    least = max(2, math.ceil(digests.count() / (0.75 * tracked)))
    return (digests.join(F.broadcast(proposed), "digest")
            .groupBy("digest").agg(F.count("*").alias("group_size"), F.min("key").alias("keep"))
            .filter(F.col("group_size") >= least))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per row of ``docs``: ``key, keep, group_size, kept, digest``.

    Texts are equal when they are identical after each run of ASCII white space
    became one space; a null text counts as empty.  The row with the smallest
    key stays; a null key is larger than all others and stays only where no
    other row has the text.  Rows that repeat both key and text are the same
    document: they count in ``group_size`` and share the verdict.  An empty
    table gives an empty result.  Other columns of ``docs`` are not read.
    """
    digests = staged(docs.select(F.col(key).alias("key"), F.sha2(normalised(whole_text(text)), 256).alias("digest")), "digests")
    frequent = staged(frequent_digests(digests, tracked), "frequent")
    hot = digests.join(F.broadcast(frequent), "digest").select("key", "keep", "group_size", "digest")
    group = Window.partitionBy("digest")
    rest = (digests.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
            .select("key", F.min("key").over(group).alias("keep"), F.count("*").over(group).alias("group_size"), "digest"))
    return hot.unionByName(rest).select("key", "keep", "group_size", F.col("key").eqNullSafe(F.col("keep")).alias("kept"), "digest")
