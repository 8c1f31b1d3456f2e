"""Set operations over keep and drop lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_keep_union(*plans: DataFrame, key: str = "path") -> DataFrame:
    """Union of what any plan needs."""
    return reduce(lambda a, b: a.unionByName(b), [p.select(key) for p in plans]).distinct()


def set_drop_merge(files: DataFrame) -> DataFrame:
    """Final drop decision per file, from flags computed once per row.

    Needs ``hash, owned, video, needed, wanted, audio, dropped_before``.  Files
    of owned folders and video go, except those an assembly needs.  Where a
    bundle holds a needed file, its other audio goes too unless its album is
    wanted.  ``apply`` marks files not already dropped.
    """
    some = files.groupBy("hash").agg(F.bool_or("needed").alias("_some"))
    f = files.join(some, "hash")
    base = (F.col("owned") | F.col("video")) & ~F.col("needed")
    narrowed = F.col("_some") & F.col("audio") & ~F.col("needed") & ~F.col("wanted")
    return (f.withColumn("drop", base | narrowed)
            .withColumn("apply", F.col("drop") & ~F.col("dropped_before")).drop("_some"))


def set_prune_to(state: DataFrame, present: DataFrame, *, key: str) -> tuple[DataFrame, DataFrame]:
    """(state rows whose key is still present, rows removed)."""
    ids = present.select(key).distinct()
    return state.join(ids, key, "left_semi"), state.join(ids, key, "left_anti")


def set_census_diff(before: DataFrame, after: DataFrame, *, key: str, value: str) -> DataFrame:
    """Keys that vanished or lost; gains are not reported."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "left")
    change = F.when(F.col("after").isNull(), "lost").when(F.col("after") < F.col("before"), "shrunk")
    return both.withColumn("change", change).filter("change IS NOT NULL")
