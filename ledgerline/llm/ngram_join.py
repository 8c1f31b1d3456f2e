"""Jaccard join of n-gram sets with several global token orders.

Under any order of all tokens, two sets that are similar enough share a token
among the first few of each (their prefixes).  Sets are sorted under ``ORDERS``
orders at once: all put rare tokens first, in coarser and coarser classes, and
each shuffles the tokens of a class by a hash of its own.  Only pairs that meet
in the prefixes of every order are compared on their full sets.

Token frequencies are counted once, by ranges of hashes.  Tokens of one set
alone come first under every order, so a set with more of these than its prefix
is long is linked with nothing and leaves; only the shared tokens of the others
go on.  Then short prefixes pair each set with a few hubs it meets, which joins
most groups of copies; in what is left only pairs of different components are
formed, in stripes of a token's sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import n_tasks, staged, whole_text
from ledgerline.llm.components import components
from ledgerline.llm.near_dedup import shingles

#: words in a shingle, and least similarity in percent
WORDS, PERCENT = 5, 80

#: token orders, and tokens of each prefix, first ones and any, that a set meets hubs by
ORDERS, FEW = 3, 3

#: tokens of a range of hashes, which one task counts at a time
RANGE = 4_000_000

#: rounds in which sets are paired with hubs only, and hubs of a token in the later ones
ROUNDS, HUBS = 2, 8

#: ranges of hashes at least
LEAST_RANGES = 40

#: sets of a token that are compared in one group
STRIPE = 512

#: tokens handled at once by a task
BATCH = 500_000

#: bytes of a token in its range
_LOW = 6

_SEEDS = np.random.default_rng(31).integers(1, 2**63, (2, ORDERS), dtype=np.uint64) | np.uint64(1)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, list[np.ndarray], list[bytes | None]]]:
    """Keys, token sets and their digests, some at a time."""
    known: dict[bytes, int] = {}
    for batch in batches:
        rows, found, total = [], [], 0
        for i, text in enumerate(batch.column(1)):
            found.append(shingles(text.as_py(), n, known))
            rows.append(i)
            total += len(found[-1])
            if total > BATCH or i + 1 == batch.num_rows:
                yield batch.column(0).take(pa.array(rows)), found, [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
                rows, found, total = [], [], 0


def sized(docs: DataFrame, n: int) -> DataFrame:
    """``key, size, digest`` of ``key, text``: the size of a document's set and a hash of it, null for no words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets, digests in _sets(batches, n):
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary())], ["key", "size", "digest"])

    return docs.mapInArrow(work, f"key {docs.schema['key'].dataType.simpleString()}, size long, digest binary")


def _by_range(docs: DataFrame, n: int, ranges: int) -> DataFrame:
    """``range, digest, size, tokens``: each set's tokens of each range of hashes, ``_LOW`` bytes a token."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, sets, digests in _sets(batches, n):
            if len(seen) > 1_000_000:
                seen.clear()
            new = {d: s for d, s in zip(digests, sets) if d is not None and d not in seen}
            if not new:
                continue
            seen.update(new)
            tokens = np.concatenate(list(new.values()))
            sizes = np.array([len(s) for s in new.values()])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = ((tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] != at[:-1])) + 1])
            low = np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :_LOW])
            ends = np.append(cut, len(tokens)).astype(np.int32) * np.int32(_LOW)
            packed = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(low)])
            names = pa.array(list(new), pa.binary()).take(pa.array(owner[cut]))
            yield pa.RecordBatch.from_arrays([pa.array(at[cut]), names, pa.array(sizes[owner[cut]]), packed], ["range", "digest", "size", "tokens"])

    return docs.mapInArrow(work, "range long, digest binary, size long, tokens binary")


def _shared(slices: DataFrame) -> DataFrame:
    """``digest, size, tokens, df`` by range: the tokens that more than one set has, and how many have them.

    A range holds about ``RANGE`` tokens, whatever the size of the corpus.
    """
    def work(table: pa.Table) -> pa.Table:
        digests = table.column("digest").combine_chunks()
        codes = pc.dictionary_encode(digests).indices.to_numpy()
        first = np.unique(codes, return_index=True)[1]
        if len(first) < len(codes):
            table = table.take(pa.array(first))
        packed = pa.concat_arrays(table.column("tokens").chunks)
        ends = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, packed.offset * 4)
        raw = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(-1, _LOW)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :_LOW] = raw
        tokens = wide.view(np.uint64).reshape(-1)
        _, at, often = np.unique(tokens, return_inverse=True, return_counts=True)
        df = often[at]
        tokens = (tokens + (np.uint64(table.column("range")[0].as_py() % (1 << 16)) << np.uint64(8 * _LOW))).view(np.int64)
        keep = df > 1
        owner = np.repeat(np.arange(len(packed)), np.diff(ends) // _LOW)[keep]
        n = np.bincount(owner, minlength=len(packed))
        rows = np.flatnonzero(n)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n[rows])]).astype(np.int32))
        picked = pa.array(rows)
        return pa.table([table.column("digest").take(picked), table.column("size").take(picked), pa.ListArray.from_arrays(offsets, pa.array(tokens[keep])),
                         pa.ListArray.from_arrays(offsets, pa.array(df[keep].astype(np.int64)))], ["digest", "size", "tokens", "df"])

    return slices.groupBy("range").applyInArrow(work, "digest binary, size long, tokens array<bigint>, df array<bigint>")


def _prefix_length(n: Column, percent: int) -> Column:
    """Tokens of a set of ``n`` among which any order has one in common with a similar set."""
    return n - F.ceil(n * percent / F.lit(100)) + 1


def prefixes(nodes: DataFrame, percent: int, few: int | None = None, orders: tuple[int, ...] = tuple(range(ORDERS))) -> DataFrame:
    """``ord, token, id, component, n, pos`` of ``id, component, n, tokens, df``: what each set has in its prefix under each order.

    ``pos`` is the token's position in the whole set, from 0.  With ``few``
    only so many of the first and so many of all.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                tokens = batch.column("tokens").flatten().to_numpy().view(np.uint64)
                df = batch.column("df").flatten().to_numpy()
                n, length = batch.column("n").to_numpy(), batch.column("length").to_numpy()
                has = pc.list_value_length(batch.column("tokens")).to_numpy().astype(np.int64)
                own = n - has  # tokens of this set alone come first
                take = np.clip(length - own, 0, has)
                owner, start = np.repeat(np.arange(len(n)), has), np.repeat(np.cumsum(has) - has, has)
                for k in orders:
                    classes = np.floor(np.log2(df) * (1 << (ORDERS - 1 - k))).astype(np.int64)
                    h = (tokens ^ _SEEDS[0, k]) * _SEEDS[1, k]
                    h ^= h >> np.uint64(32)
                    order = np.lexsort((tokens, h, classes, owner))
                    pos = np.arange(len(order)) - start
                    picked = pos < take[owner]
                    if few is not None:
                        # of the prefix the first, and those of least hash: what groups have in common may come after what each has alone
                        low = np.lexsort((h[order] * _SEEDS[0, 0], ~picked, owner))
                        rank = np.empty(len(order), np.int64)
                        rank[low] = np.arange(len(order)) - start
                        picked &= (pos < few) | (rank < few)
                    who = pa.array(owner[picked])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(who), k, np.int32)), pa.array(tokens[order[picked]].view(np.int64)), batch.column("id").take(who), batch.column("component").take(who),
                        pa.array(n[owner[picked]]), pa.array((pos + own[owner])[picked])], ["ord", "token", "id", "component", "n", "pos"])

    kind = nodes.schema["id"].dataType.simpleString()
    with_length = nodes.select("id", "component", F.col("n").cast("long").alias("n"), "tokens", "df", _prefix_length(F.col("n"), percent).cast("long").alias("length"))
    return with_length.mapInArrow(work, f"ord int, token long, id {kind}, component {kind}, n long, pos long")


def _in_all_orders(pairs: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that come under every order."""
    return pairs.groupBy("a", "b").agg(F.bit_or(F.pow(F.lit(2), F.col("ord")).cast("int")).alias("met")).filter(F.col("met") == (1 << ORDERS) - 1).select("a", "b")


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _first_met(tokens: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs of each set with the hubs of another component that it meets by a token, under all orders.

    The hub of a token's sets is the one of the smallest key, at seed 0, or
    else ``HUBS`` of them by as many hashes of their keys.
    """
    one = F.struct("id", "component", "n")
    picked = [F.min(one)] if seed == 0 else [F.min_by(one, F.xxhash64(F.lit(seed * HUBS + i), "id")) for i in range(HUBS)]
    hubs = tokens.groupBy("ord", "token").agg(F.array(*picked).alias("hubs"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    each = hubs.select("ord", "token", F.explode(F.array_distinct("hubs")).alias("hub"))
    met = tokens.join(each, ["ord", "token"]).filter("component <> hub.component").filter(_sizes_fit("n", "hub.n", percent))
    return _in_all_orders(met.select(F.least("hub.id", "id").alias("a"), F.greatest("hub.id", "id").alias("b"), "ord"))


def _crossing(tokens: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets in different components that meet under every order at positions where they still can be similar enough.

    A token's sets are dealt into stripes; each set meets one stripe in a group.
    """
    open_ = tokens.groupBy("ord", "token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).filter("lo < hi")
    placed = tokens.join(open_.select("ord", "token", F.ceil(F.col("members") / F.lit(STRIPE)).cast("int").alias("stripes")), ["ord", "token"])
    left = placed.select("ord", "token", F.pmod(F.xxhash64("id"), F.col("stripes")).cast("int").alias("stripe"), *(F.col(c).alias(f"a_{c}") for c in ("id", "component", "n", "pos")))
    right = placed.select("ord", "token", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"), *(F.col(c).alias(f"b_{c}") for c in ("id", "component", "n", "pos")))
    least = F.ceil(percent * (F.col("a_n") + F.col("b_n")) / F.lit(100 + percent))  # tokens in common
    could = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))  # if this token is the first in common
    met = left.join(right, ["ord", "token", "stripe"]).filter("a_id < b_id AND a_component <> b_component").filter(_sizes_fit("a_n", "b_n", percent)).filter(could >= least)
    return _in_all_orders(met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "ord"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets have the similarity; what they have in common is among their shared tokens."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("_i", F.size(F.array_intersect("t_a", "t_b")))
    return joined.filter(100 * F.col("_i") >= percent * (F.col("n_a") + F.col("n_b") - F.col("_i"))).select("a", "b")


def _placed(nodes: DataFrame, joined: DataFrame | None) -> DataFrame:
    """``nodes`` with the component that each has so far."""
    if joined is None:
        return nodes.withColumn("component", F.col("id"))
    return nodes.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _still_open(nodes: DataFrame, percent: int) -> DataFrame:
    """Those ``nodes`` that may be similar to one of another component.

    They meet another component's set in the prefix of each order, and share
    enough of their tokens with other components.  One order after the other,
    each on what the last has left.
    """
    open_ = lambda each: each.groupBy("ord", "token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("ord", "token")
    for k in range(ORDERS):
        each = prefixes(nodes, percent, orders=(k,))
        able = each.join(open_(each), ["ord", "token"], "left_semi").select("id").distinct()
        nodes = staged(nodes.join(able, "id", "left_semi"), "open")
    each = nodes.select("id", "n", "component", F.lit(0).alias("ord"), F.explode("tokens").alias("token"))
    enough = each.join(open_(each), ["ord", "token"], "left_semi").groupBy("id", "n").agg(F.count("*").alias("c")).filter(100 * F.col("c") >= percent * F.col("n"))
    return staged(nodes.join(enough.select("id"), "id", "left_semi"), "open")


def joined_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component``, one row per row of ``docs``.

    Documents are linked whose sets of ``words``-word shingles have a Jaccard
    similarity of ``percent`` or more; the component is the smallest key
    reachable by links.  No link is missed.  Words are separated by ASCII white
    space, A-Z count as a-z; a text of fewer words is one shingle.  Null, empty
    and blank texts have no shingles and are linked with nothing.  Rows with a
    null key are linked with nothing either (their component is null).  Rows
    that repeat a key are each judged by their own text.  Texts may be of any
    length.  An empty table gives an empty result; other columns are not read.

    Rows of equal sets are one set, known by its smallest key.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    sizes = staged(sized(rows, words), "sizes")
    reps = sizes.filter("digest IS NOT NULL AND key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("id"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    slices = _by_range(rows.filter(F.col("key").isNotNull()), words, max(LEAST_RANGES, -(-total // RANGE)))
    parts = _shared(slices).groupBy("digest").agg(F.first("size").alias("n"), F.collect_list(F.struct("tokens", "df")).alias("parts"))
    able = parts.select("digest", "n", F.flatten("parts.tokens").alias("tokens"), F.flatten("parts.df").alias("df")).filter(100 * F.size("tokens") >= percent * F.col("n"))
    nodes = staged(able.join(reps, "digest").select("id", "n", "tokens", "df"), "nodes")

    links, joined = None, None
    for seed in range(ROUNDS):
        met = _first_met(prefixes(_placed(nodes, joined), percent, FEW), percent, seed)
        found = staged(_confirmed(met, nodes, percent), "links")
        links = found if links is None else links.unionByName(found)
        joined = components(links)
    left = _still_open(_placed(nodes, joined), percent)
    more = staged(_confirmed(_crossing(staged(prefixes(left, percent), "prefixes"), percent), left, percent), "links")

    final = components(links.unionByName(more))
    of_set = reps.join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    return sizes.join(of_set, "digest", "left").select(
        "key", F.col("size").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component"))
