"""Mixing sources to target weights, in blocks of a fixed number of words.

The words of a source, document after document, are packed into blocks of one
length.  Every source gets a number of output slots that meets its target; each
slot goes to an output shard drawn by hash, so the counts of a source over the
shards are multinomial.  A slot finds its block through a pseudorandom
permutation of the source's block numbers, once per pass over the source, and
the join on the block number brings the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import n_tasks, staged, whole_text, words

#: words in a block
BLOCK = 64

#: parts into which the documents of each source are dealt to be numbered
PARTS = 4096

#: slots made by one row of the slot table's first step
RUN = 8192

#: output shards
SHARDS = 256

#: rounds of the permutation
ROUNDS = 10

#: weights of the sources in order of code points, null last, repeating
WEIGHTS = (3, 1, 2)

#: all targets together, as a multiple of all words
SHARE = 1.5

#: a target is at most so many times its source's size; so often is a block taken at most
MOST = 2


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Add ``rank`` and ``target`` to ``source, source_size``, one row per source.

    Shares by weight, filled up to ``MOST`` times the size: in ascending order
    of size per weight, a source is full if the level that fills it does not
    exceed what is there.  The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = (sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("_w", weight.cast("double"))
              .withColumn("_cap", F.lit(float(MOST)) * F.col("source_size")).withColumn("_level", F.col("_cap") / F.col("_w")))
    up = Window.orderBy("_level", "rank")
    everything = Window.partitionBy()
    level = (F.col("_total") - F.col("_full")) / F.col("_left")
    filled = (ranked.withColumn("_total", F.lit(SHARE) * F.sum("source_size").over(everything))
              .withColumn("_full", F.sum("_cap").over(up.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("_full", F.coalesce("_full", F.lit(0.0)))
              .withColumn("_left", F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing)))
              # the level if this source and those after it share what the earlier ones leave
              .withColumn("_share", level))
    # the first source that its share does not fill sets the level for itself and all after it
    shared = F.min(F.when(F.col("_share") < F.col("_level"), F.struct("_level", "rank", "_share"))).over(everything)
    return (filled.withColumn("_stop", shared)
            .withColumn("target", F.when(F.col("_stop").isNull() | (F.struct("_level", "rank") < F.struct("_stop._level", "_stop.rank")), F.col("_cap"))
                        .otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_stop._share"))))
            .select("source", "source_size", "rank", "target"))


def permuted(index: Column, count: Column, *seeds: Column) -> Column:
    """Image of ``index`` under a pseudorandom permutation of 0 .. count-1.

    Swap-or-not: a round pairs x with (k - x) mod count and swaps the pair or
    not by a hash of its larger member, which is a permutation for any count.
    """
    return _rounds(index, count, F.sequence(F.lit(1), F.lit(ROUNDS)), *seeds)


def _rounds(index: Column, count: Column, rounds: Column, *seeds: Column) -> Column:
    def one(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*seeds, r), count) - x, count)
        swap = F.xxhash64(*seeds, r, F.greatest(x, partner)) % 2 == 0
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(rounds, index, one)


def placed(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``key, source, digest, copy, size, start``: where each document's words begin in its source.

    Documents of a source are dealt to ``PARTS`` parts by a hash of key and text
    and numbered within each part; offsets of the parts come from their sums.
    So no task sees a whole source.  ``digest`` and ``copy`` tell rows of one
    key apart.
    """
    sized = staged(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.xxhash64(whole_text(text)).alias("digest"), n_words(whole_text(text)).alias("size"))
                   .withColumn("part", F.pmod(F.xxhash64("key", "digest"), F.lit(PARTS)).cast("int")), "sized")
    in_order = Window.partitionBy("source", "part").orderBy("key", "digest")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (sized.groupBy("source", "part").agg(F.sum("size").alias("_size"))
             .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size"))
    # rows of one key and text are as good as each other
    numbered = sized.withColumns({"copy": F.row_number().over(in_order) - F.rank().over(in_order) + 1,
                                  "_inside": F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    joined = numbered.alias("d").join(parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part")))
    return staged(joined.select("d.key", "d.source", "d.digest", "d.copy", "d.size", (F.col("_before") + F.col("_inside")).alias("start")), "placed")


def unpermuted(image: Column, count: Column, *seeds: Column) -> Column:
    """The index whose image under :func:`permuted` is ``image``: each round undoes itself, the last first."""
    return _rounds(image, count, F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)), *seeds)


def with_slots(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Add ``n_blocks, n_slots, last_n``: how many slots a source fills, and the words of the last one.

    Slots take whole passes over a source, and of one more as many blocks as
    the target still lacks; the last slot takes only the words that are lacking.
    All blocks are full but the source's last, so the words before a slot follow
    from where the permutation puts that one.
    """
    words_wanted = F.least(F.round("target").cast("long"), MOST * F.col("source_size"))
    some = sources.withColumn("n_blocks", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn("_want", words_wanted)
    some = some.withColumns({"_turns": F.expr("IF(source_size > 0, _want div source_size, 0L)"), "_rest": F.expr("IF(source_size > 0, _want % source_size, 0L)")})
    lacking = F.lit(block) - F.when(F.col("source_size") > 0, F.col("source_size") - (F.col("n_blocks") - 1) * block).otherwise(block)
    at = unpermuted(F.col("n_blocks") - 1, F.greatest("n_blocks", F.lit(1)), F.lit(seed), F.col("rank"), F.col("_turns"))
    some = some.withColumn("_lacking", lacking).withColumn("_at", at)
    # blocks that reach the rest: without the short one, or with it among them
    some = some.withColumn("_more", F.expr(f"IF(_rest <= _at * {block}, (_rest + {block - 1}) div {block}, (_rest + _lacking + {block - 1}) div {block})"))
    before = F.greatest(F.col("_more") - 1, F.lit(0)) * block - F.when((F.col("_more") - 1 > F.col("_at")), F.col("_lacking")).otherwise(0)
    some = some.withColumn("last_n", F.when(F.col("_rest") > 0, F.col("_rest") - before))
    return some.withColumn("n_slots", F.col("_turns") * F.col("n_blocks") + F.col("_more")).drop("_want", "_turns", "_rest", "_lacking", "_at", "_more")


def slots(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """``rank, slot, pass, block, shard, most`` of every output slot; ``most`` is how many words of the block it takes.

    Slot k draws its shard by hash and takes block permutation(k mod n) of pass
    k div n.
    """
    runs = (sources.filter("n_slots > 0")
            .withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_slots - 1) div {RUN}"))))
            .repartition(n_tasks(sources.sparkSession), "rank", "_run"))
    each = runs.withColumn("slot", F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("n_slots"), (F.col("_run") + 1) * RUN) - 1)))
    turn = F.expr("slot div n_blocks")
    last = (F.col("slot") == F.col("n_slots") - 1) & F.col("last_n").isNotNull()
    return each.select("rank", "slot", turn.cast("int").alias("pass"),
                       permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("rank"), turn).alias("block"),
                       F.pmod(F.xxhash64(F.lit(seed), F.col("rank"), F.col("slot"), F.lit("shard")), F.lit(SHARDS)).cast("int").alias("shard"),
                       F.when(last, F.col("last_n")).otherwise(F.lit(block)).alias("most"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 1):
    """The mix as two tables: ``documents`` and ``pieces``.

    ``documents`` has one row per row of ``docs``: ``key, source, size,
    source_size, target, taken``.  ``pieces`` has one row for each stretch of a
    document in an output slot: ``key, source, digest, copy, size, start, at, n,
    pass, shard, slot, rank`` (``at`` is the first word, ``n`` the number of
    words; ``digest`` and ``copy`` tell rows of one key apart).

    A null text has size 0, a null source is a source of its own, null keys are
    documents of their own.  Repeated rows are packed one after the other.
    Sources without words have target 0.  An empty table gives empty results.
    Same rows and seed give the same mix, whatever the partitioning.
    """
    where = placed(docs, key, text, source)
    sizes = where.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = staged(with_slots(targets(sizes), block, seed), "sources")
    ranked = where.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "rank", "source_size", "target")
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    cut = (ranked.filter("size > 0").select("key", "source", "digest", "copy", "size", "start", "rank", F.explode(F.sequence(first, last)).alias("block"))
           .withColumn("at", F.greatest(F.col("block") * block - F.col("start"), F.lit(0)))
           .withColumn("n", F.least((F.col("block") + 1) * block - F.col("start"), F.col("size")) - F.col("at")))
    # both sides grow with the input, though Spark cannot tell from the few sources that the slots come from
    inside = F.col("start") + F.col("at") - F.col("block") * block  # where a piece begins in its block
    pieces = (cut.join(slots(sources, block, seed).hint("merge"), ["rank", "block"]).withColumn("n", F.least(F.col("n"), F.col("most") - inside)).filter("n > 0")
              .select("key", "source", "digest", "copy", "size", "start", "at", "n", "pass", "shard", "slot", "rank"))
    taken = pieces.groupBy("rank", "start").agg(F.sum("n").alias("taken"))
    with_words = ranked.filter("size > 0").join(taken, ["rank", "start"], "left")
    out = ["key", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    documents = with_words.select(*out).unionByName(ranked.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))
    return documents, pieces


def mixed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 1) -> DataFrame:
    """The mix as rows with the columns of ``docs``: one row per document and pass.

    The text of a row is what the mix takes of the document in that pass:
    unchanged if it takes all, else the taken words joined by one space; a
    column ``n_chars`` follows.  Documents of which nothing is taken are gone,
    texts without words too.  Every row has its own pieces; rows that repeat
    key, source and text share theirs out among them.
    """
    _, pieces = mix(docs, key, text, source, block, seed)
    spans = (pieces.groupBy("key", "source", "digest", "copy").agg(F.array_sort(F.collect_list(F.struct("pass", "at", "n"))).alias("_spans"))
             .withColumnsRenamed({"key": "_key", "source": "_source", "digest": "_digest", "copy": "_copy"}))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_k"), F.col(source).alias("_s"), F.xxhash64(whole_text(text)).alias("_d"), n_words(whole_text(text)).alias("_n"))
    rows = rows.withColumn("_c", F.row_number().over(Window.partitionBy("_k", "_s", "_d").orderBy("_n")))
    own = F.col("_k").eqNullSafe(F.col("_key")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_d") == F.col("_digest")) & (F.col("_c") == F.col("_copy"))
    passes = (rows.join(spans, own)
              .withColumn("_pass", F.explode(F.array_distinct(F.transform("_spans", lambda s: s["pass"]))))
              .withColumn("_spans", F.filter("_spans", lambda s: s["pass"] == F.col("_pass")))
              .withColumn("_all", F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["n"]) == F.col("_n"))
              .withColumn("_words", F.when(~F.col("_all"), words(F.col("_row")[text]))))
    chosen = F.flatten(F.transform("_spans", lambda s: F.slice(F.col("_words"), (s["at"] + 1).cast("int"), s["n"].cast("int"))))
    out = passes.withColumn("_text", F.when(F.col("_all"), F.col("_row")[text]).otherwise(F.array_join(chosen, " ")))
    changed = {text: F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_all"), F.col("_row")["n_chars"]).otherwise(F.char_length("_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
