"""Building blocks shared by the operators: skew-safe picks, joins and sums."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import shared_folder

#: a lookup table of at most so many bytes, as counted, goes to every task instead of moving the rows
LOOKUP_BYTES = 8_000_000



def top_per_group(df: DataFrame, keys: Sequence, order: Sequence[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per group in ``order``.

    A filter on ``row_number`` lets Spark plan ``WindowGroupLimit``: every map
    task keeps only ``k`` rows per group before the shuffle, so a group that
    holds a third of all rows never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even partitions ahead of a Python stage.

    The number is given explicitly because pairs are few bytes but much work,
    and adaptive coalescing, which looks at bytes, would put them in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    For stages that several later branches read: each would otherwise compute
    the whole lineage again.  Survives the loss of executors.
    """
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Like :func:`cut` for tables of many rows: in columns, a fraction of the size."""
    folder = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def key_table(df: DataFrame, column: str, **keys: Callable[[Column], Column]) -> DataFrame:
    """One row for each distinct text of ``column``, with its keys."""
    texts = spread(df.select(column).distinct(), column)
    return texts.select(column, *(make(F.col(column)).alias(name) for name, make in keys.items()))


def attach(df: DataFrame, table: DataFrame, *on: str) -> DataFrame:
    """``df`` with what ``table``, one row for each key, holds for it; rows without one stay, NULL meets NULL."""
    table = kept(table)
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()[0] or 0
    sides = table.withColumnsRenamed({c: f"_on_{c}" for c in on})
    met = F.lit(True)
    for c in on:
        met = met & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return df.join(F.broadcast(sides) if size <= LOOKUP_BYTES else sides.hint("merge"), met, "left").drop(*(f"_on_{c}" for c in on))


def with_keys(df: DataFrame, column: str, **keys: Callable[[Column], Column]) -> DataFrame:
    """``df`` with keys of a text column, worked out once for each distinct text.

    Keys cost far more than a join, and tables repeat their titles and names.
    """
    return attach(df, key_table(df, column, **keys), column)


def best_row(columns: Sequence[str], order: Sequence[Column]) -> Column:
    """Aggregate: struct of ``columns`` of the first row in ``order`` (ascending)."""
    return F.min_by(F.struct(*columns), F.struct(*order))


def nearest_within(left: DataFrame, right: DataFrame, *, keys: Sequence[str], value: str,
                   tolerance: int, ordinal: str, found: str = "ordinal_found") -> DataFrame:
    """Nearest ``right`` value within ``tolerance`` for every distinct left value.

    Works on distinct values, split into buckets eight tolerances wide (a right
    value within one tolerance of a border is copied to the next bucket).  A
    bucket therefore never holds more than ``10 * tolerance + 10`` values per
    key however skewed the rows are, and no pair is ever formed: both
    neighbours come from one sorted scan.  Ties go to the lowest ordinal.
    Returns keys, value, ``found`` and ``delta``.
    """
    width = 8 * max(int(tolerance), 1)
    near_to = lambda v: F.floor(v / width)
    bucket = near_to(F.col(value))
    reached = F.array_distinct(F.array(near_to(F.col(value) - tolerance), near_to(F.col(value) + tolerance)))
    lefts = left.select(*keys, value).distinct().select(
        *keys, value, bucket.alias("_b"), F.lit(None).cast(right.schema[ordinal].dataType).alias("_o"), F.lit(1).alias("_side"))
    rights = (right.groupBy(*keys, value).agg(F.min(ordinal).alias("_o"))
              .select(*keys, value, F.explode(reached).alias("_b"), "_o", F.lit(0).alias("_side")))
    both = lefts.unionByName(rights).withColumn(
        "_r", F.when(F.col("_side") == 0, F.struct(F.col(value).alias("v"), F.col("_o").alias("o"))))
    up = Window.partitionBy(*keys, "_b").orderBy(F.col(value), F.col("_side"))
    down = Window.partitionBy(*keys, "_b").orderBy(F.col(value).desc(), F.col("_side"))
    run = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = (both.withColumn("_p", F.last("_r", ignorenulls=True).over(run(up)))
            .withColumn("_n", F.last("_r", ignorenulls=True).over(run(down)))
            .filter(F.col("_side") == 1))
    option = lambda c: F.when(F.abs(F.col(f"{c}.v") - F.col(value)) <= tolerance,
                              F.struct(F.abs(F.col(f"{c}.v") - F.col(value)).alias("delta"), F.col(f"{c}.o").alias("o")))
    best = F.array_min(F.filter(F.array(option("_p"), option("_n")), lambda x: x.isNotNull()))
    return (near.withColumn("_best", best).filter(F.col("_best").isNotNull())
            .select(*keys, value, F.col("_best.o").alias(found), F.col("_best.delta").alias("delta")))


def _grams(text: Column, q: int) -> Column:
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: i + (q - 1) <= n)
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(q))))


def contains_pairs(inner: DataFrame, outer: DataFrame, *, keys: Sequence[str] = (),
                   inner_text: str, outer_text: str) -> DataFrame:
    """Distinct text pairs where ``inner_text`` occurs inside ``outer_text``.

    Blocked on the rarest three-letter piece of the inner text, so the join is
    an equi-join and loses nothing.  Shorter inner texts are their own piece.

    Pieces are many times the size that Spark estimates from the compressed
    columns they come from, so the hints keep them from being broadcast.
    """
    ins = inner.select(*keys, F.col(inner_text).alias("_in")).filter("_in <> ''").distinct()
    outs = outer.select(*keys, F.col(outer_text).alias("_out")).filter("_out <> ''").distinct()
    q = F.least(F.length("_in"), F.lit(3))
    pieces = F.when(q == 3, _grams(F.col("_in"), 3)).otherwise(F.array("_in"))
    in_pieces = ins.select(*keys, "_in", F.explode(pieces).alias("_g"))
    wanted = in_pieces.select(*keys, "_g").distinct()
    out_pieces = (outs.select(*keys, "_out", F.explode(F.array_distinct(F.concat(
        _grams(F.col("_out"), 1), _grams(F.col("_out"), 2), _grams(F.col("_out"), 3)))).alias("_g"))
        .join(wanted.hint("shuffle_hash"), [*keys, "_g"], "left_semi"))
    counts = out_pieces.groupBy(*keys, "_g").agg(F.count("*").alias("_df"))
    rarest = (in_pieces.join(counts.hint("shuffle_hash"), [*keys, "_g"], "left")
              .groupBy(*keys, "_in")
              .agg(F.min_by("_g", F.struct(F.coalesce("_df", F.lit(0)), "_g")).alias("_g"),
                   F.min(F.coalesce("_df", F.lit(0))).alias("_least"))
              .filter(F.col("_least") > 0).drop("_least"))
    return (rarest.hint("merge").join(out_pieces, [*keys, "_g"])
            .filter(F.contains(F.col("_out"), F.col("_in")))
            .select(*keys, F.col("_in").alias("inner_text"), F.col("_out").alias("outer_text")))


def contains_first(inner: DataFrame, outer: DataFrame, *, inner_text: str, outer_text: str, ordinal: str, value: str) -> DataFrame:
    """``inner_text, value``: of the outer texts that contain an inner one, the value of the least ordinal.

    An inner text of up to three letters is a piece of every outer text that
    contains it: each piece keeps only its least ordinal, so such a text makes
    one row however many contain it.  Longer ones go through
    :func:`contains_pairs`.
    """
    ins = inner.select(F.col(inner_text).alias("inner_text")).filter("inner_text <> ''").distinct()
    outs = outer.filter(F.col(outer_text) != "").groupBy(F.col(outer_text).alias("_out")).agg(F.min(F.struct(F.col(ordinal).alias("o"), F.col(value).alias("v"))).alias("_best"))
    brief = F.length("inner_text") <= 3
    pieces = outs.select("_best", F.explode(F.array_distinct(F.concat(*(_grams(F.col("_out"), q) for q in (1, 2, 3))))).alias("inner_text"))
    short = pieces.join(ins.filter(brief), "inner_text", "left_semi").groupBy("inner_text").agg(F.min("_best").alias("_best"))
    pairs = contains_pairs(ins.filter(~brief), outs, inner_text="inner_text", outer_text="_out")
    long = pairs.hint("merge").join(outs, pairs["outer_text"] == outs["_out"]).groupBy("inner_text").agg(F.min("_best").alias("_best"))
    return short.unionByName(long).select("inner_text", F.col("_best.v").alias(value))


def _in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """Rows dealt by sampled borders of ``order`` into one part ``_p`` for each task: as many in each, in order from part to part."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: the borders come from a sample, and all that follows must see the same
    return cut(df.repartitionByRange(tasks, *order).withColumn("_p", F.spark_partition_id()))


def _from_part(rows: DataFrame, value: Column) -> DataFrame:
    """``_p, _before``: the sum of ``value`` over all parts before.  One row for each part."""
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("_p").agg(F.sum(value).alias("_s")).select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))


def prefix_sum(df: DataFrame, *, order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all rows before each in ``order``.

    Sums run inside ranges of the order, which sampled borders make even however
    the values lie; only the sums of whole ranges cross ranges.
    """
    rows = _in_ranges(df, F.col(order).asc())
    w = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0)))
            .join(_from_part(rows, F.col(value)), "_p").withColumn(out, F.col("_in") + F.col("_before")).drop("_p", "_in", "_before"))


def numbered(df: DataFrame, *order: Column, out: str = "rank") -> DataFrame:
    """Rows with their number, from 1, in ``order``; ranges as in :func:`prefix_sum`."""
    rows = _in_ranges(df, *order)
    w = Window.partitionBy("_p").orderBy(*order)
    return (rows.withColumn("_in", F.row_number().over(w)).join(_from_part(rows, F.lit(1)), "_p")
            .withColumn(out, F.col("_in") + F.col("_before")).drop("_p", "_in", "_before"))


def with_neighbours(df: DataFrame, *, key: str, ts: str, bucket: int, ordinal: str | None = None) -> DataFrame:
    """Add ``prev`` and ``next``: the neighbouring ``ts`` of the same key, ties by ``ordinal``.

    Windows run per (key, time bucket); only the first and last time of each
    bucket cross buckets.  One key with a third of all rows is thus sorted by
    as many tasks as it has buckets.
    """
    b = F.floor(F.col(ts) / bucket)
    rows = df.withColumn("_b", b)
    edges = rows.groupBy(key, "_b").agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    wk = Window.partitionBy(key).orderBy("_b")
    edges = edges.select(key, "_b", F.lag("_hi").over(wk).alias("_before"), F.lead("_lo").over(wk).alias("_after"))
    w = Window.partitionBy(key, "_b").orderBy(ts, *([ordinal] if ordinal else []))
    return (rows.withColumn("_p", F.lag(ts).over(w)).withColumn("_n", F.lead(ts).over(w))
            .join(edges, [key, "_b"])
            .withColumn("prev", F.coalesce("_p", "_before")).withColumn("next", F.coalesce("_n", "_after"))
            .drop("_b", "_p", "_n", "_before", "_after"))
