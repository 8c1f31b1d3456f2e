"""Near-duplicate groups: MinHash signatures in a multi-index Hamming join.

A signature has ``SYMBOLS`` minima of ``BITS`` bits.  Two signatures are close
if at most ``DISTANCE`` symbols differ.  Cut into chunks, close signatures have,
by the pigeonhole principle, one chunk with at most one wrong symbol, so each
chunk is indexed with each of its symbols left out in turn: every close pair
meets in a bucket, none is missed.  Pairs that meet and are close are confirmed
on the full shingle sets.

First every document is paired with the least of each of its buckets only.
What these links join need not be paired again: the second step pairs just
documents of one bucket that are still in different components.  What a
document has in common with all others that are left bounds what it has in
common with any, so documents and pairs fall out that cannot be similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import n_tasks, staged, whole_text
from ledgerline.llm.components import components

SYMBOLS, BITS, CHUNK = 48, 16, 4

#: most symbols that differ in a close pair.  With 12 chunks of which one has at
#: most one error, up to 23 are found; at a similarity of 0.8 more differ in 2 of 10**6 pairs
DISTANCE = 2 * (SYMBOLS // CHUNK) - 1

#: words in a shingle, and least similarity in percent
WORDS, PERCENT = 5, 80

#: bits of a set's outline
OUTLINE = 1_024

#: members of a bucket that are compared in one group; larger buckets are dealt into stripes of about as many
STRIPE = 512

#: shingles handled at once by a task
BATCH = 400_000

_SEEDS = np.random.default_rng(20).integers(1, 2**63, (3, SYMBOLS), dtype=np.uint64) | np.uint64(1)
_ORDER = np.random.default_rng(21).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str, n: int, known: dict[bytes, int]) -> np.ndarray:
    """The set of hashed shingles, sorted: A-Z in lower case, n words each, fewer words as one."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if not tokens:
        return np.empty(0, np.uint64)
    if len(known) > 300_000:
        known.clear()
    hashes = []
    for w in tokens:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    words = np.array(hashes, np.uint64)
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out * _ORDER[i % 64] + words[i:i + len(out)])
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``SYMBOLS`` minima of every non-empty set, packed ``CHUNK`` to an int64."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), np.uint64)
    for k in range(SYMBOLS):
        h = (flat ^ _SEEDS[0, k]) * _SEEDS[1, k]
        h ^= h >> np.uint64(32)
        h *= _SEEDS[2, k]
        out[:, k] = np.minimum.reduceat(h, starts)
    symbols = (out & np.uint64((1 << BITS) - 1)).reshape(len(sets), SYMBOLS // CHUNK, CHUNK)
    shifts = np.arange(CHUNK, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(symbols << shifts, axis=2).view(np.int64)


def outline(s: np.ndarray) -> list[int]:
    """A bit for each shingle, by its hash.  Sets differ in at least as many shingles as outlines in bits."""
    bits = np.zeros(OUTLINE, bool)
    bits[(s & np.uint64(OUTLINE - 1)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64).tolist()


def sketched(docs: DataFrame, n: int) -> DataFrame:
    """``key, size, digest, sig, bits`` of ``key, text``: set size, hash of the whole set, signature and outline (null for no words)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}

        def out(keys: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full)) if full else iter(())
            return pa.RecordBatch.from_arrays([
                pa.array(keys), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(sigs) if len(s) else None for s in sets], pa.list_(pa.int64())),
                pa.array([outline(s) if len(s) else None for s in sets], pa.list_(pa.int64()))], ["key", "size", "digest", "sig", "bits"])

        for batch in batches:
            keys, sets, total = [], [], 0
            for i, text in enumerate(batch.column(1)):
                sets.append(shingles(text.as_py(), n, known))
                total += len(sets[-1])
                keys.append(i)
                if total > BATCH:
                    yield out(batch.column(0).take(pa.array(keys)), sets)
                    keys, sets, total = [], [], 0
            if keys:
                yield out(batch.column(0).take(pa.array(keys)), sets)

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(work, f"key {kind}, size long, digest binary, sig array<bigint>, bits array<bigint>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """``key, shingles``: the whole set of each document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sets = [shingles(t.as_py(), n, known).view(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["key", "shingles"])

    return docs.mapInArrow(work, f"key {docs.schema['key'].dataType.simpleString()}, shingles array<bigint>")


def distance(a: Column, b: Column) -> Column:
    """Number of symbols in which two signatures differ: lanes of their XOR that are not zero."""
    low, high = 0x00007FFF7FFF7FFF, 0x0000800080008000  # the top lane by itself, for sums must not overflow
    out = F.lit(0)
    for i in range(SYMBOLS // CHUNK):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        lanes = (x.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(high))
        out = out + F.bit_count(lanes) + (F.shiftrightunsigned(x, 48) != 0).cast("int")
    return out


def buckets(reps: DataFrame) -> DataFrame:
    """``bucket, id, hub``: each chunk with one symbol left out; buckets of one are gone."""
    masks = [~(((1 << BITS) - 1) << (BITS * j)) for j in range(CHUNK)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in (m & ((1 << 64) - 1) for m in masks)]
    keys = F.flatten(F.transform("sig", lambda x, i: F.array(*(F.xxhash64(i, F.lit(j), x.bitwiseAND(F.lit(m))) for j, m in enumerate(signed)))))
    each = reps.select(F.col("id"), F.explode(keys).alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("hub")).filter("n > 1 AND hub IS NOT NULL")
    return each.join(shared.select("bucket", "hub"), "bucket")


def _close(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct pairs ``a, b`` whose signatures are close and whose sizes allow the similarity."""
    sig = lambda x: reps.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"))
    return pairs.distinct().join(sig("b"), "b").join(sig("a"), "a").filter(distance(F.col("sig_a"), F.col("sig_b")) <= DISTANCE).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have the similarity."""
    side = lambda x: sets.select(F.col("key").alias(x), F.col("shingles").alias(f"set_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    common = joined.withColumn("_i", F.size(F.array_intersect("set_a", "set_b")))
    return common.filter(100 * F.col("_i") >= percent * (F.size("set_a") + F.size("set_b") - F.col("_i"))).select("a", "b")


def _with_partners(sets: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """``id, n, shared`` of those ``ids`` of whose shingles enough, ``shared`` of ``n``, occur in another set of ``ids``."""
    each = sets.join(ids.withColumnRenamed("id", "key"), "key", "left_semi").select("key", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1")
    kept = each.join(shared, "s", "left_semi").groupBy("key", "n").agg(F.count("*").alias("c"))
    return kept.filter(100 * F.col("c") >= percent * F.col("n")).select(F.col("key").alias("id"), "n", F.col("c").alias("shared"))


def _open(placed: DataFrame) -> DataFrame:
    """Buckets that hold more than one component; ``members`` counts theirs."""
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).filter("lo < hi")
    return placed.join(mixed.select("bucket", "members"), "bucket")


def _crossing(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of one bucket in different components that may be similar enough.

    Compared in blocks: a large bucket is dealt into stripes, and each two
    stripes meet in a group of their own, so no task sees a whole bucket.  A
    pair comes out only if signatures are close and if neither what its sets
    have in common with others nor their outlines rule it out; it can come out
    of several buckets.
    """
    stripes = F.ceil(F.col("members") / F.lit(STRIPE)).cast("int")
    own = F.pmod(F.xxhash64("id"), stripes).cast("int")
    dealt = (placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), stripes - 1)))
             .select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "component", "n", "shared", "sig", "bits"))
    kind = placed.schema["id"].dataType.simpleString()

    def pairs(ids: list, own: np.ndarray, component: list, n: np.ndarray, shared: np.ndarray, sig: np.ndarray, bits: np.ndarray, across: bool) -> list[tuple]:
        out = []
        names = {c: i for i, c in enumerate(dict.fromkeys(component))}
        group = np.array([names[c] for c in component])
        for i in range(len(ids) - 1):
            js = np.arange(i + 1, len(ids))
            most = np.minimum(shared[i], shared[js])
            js = js[(group[js] != group[i]) & ((own[js] != own[i]) if across else True) & (100 * most >= percent * (n[i] + n[js] - most))]
            js = js[((100 + percent) * np.bitwise_count((bits[js] ^ bits[i]).view(np.uint64)).sum(1, dtype=np.int64) <= (100 - percent) * (n[i] + n[js]))]
            js = js[(sig[js].view(np.uint16) != sig[i].view(np.uint16)).sum(1) <= DISTANCE]
            out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in js.tolist() if ids[i] != ids[j]]
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            col = lambda c: t.column(c).to_numpy()
            flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            bucket, lo, hi = col("bucket"), col("lo"), col("hi")
            ids, component, own, n, shared, sig, bits = t.column("id").to_pylist(), t.column("component").to_pylist(), col("own"), col("n"), col("shared"), flat("sig"), flat("bits")
            cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            out = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(t)]):
                out += pairs(ids[a:b], own[a:b], component[a:b], n[a:b], shared[a:b], sig[a:b], bits[a:b], bool(lo[a] != hi[a]))
            if out:
                found = set(out)
                yield pa.RecordBatch.from_arrays([pa.array(x, t.schema.field("id").type) for x in zip(*found)], ["a", "b"])

        last = None
        for batch in batches:
            # groups are runs of rows; the last one of a batch may go on in the next
            keys = [batch.column(i).to_numpy() for i in range(3)]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if batch.num_rows > 1 else np.empty(0, int)
            if held and last != tuple(k[0] for k in keys):
                yield from flush()
                held = []
            if len(change):
                held.append(batch.slice(0, int(change[-1])))
                yield from flush()
                held = [batch.slice(int(change[-1]))]
            else:
                held.append(batch)
            last = tuple(k[-1] for k in keys)
        if held:
            yield from flush()

    n = n_tasks(placed.sparkSession)
    return dealt.repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(work, f"a {kind}, b {kind}")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component``, one row per row of ``docs``.

    Documents are linked whose sets of ``words``-word shingles have a Jaccard
    similarity of ``percent`` or more; the component is the smallest key
    reachable.  Words are separated by ASCII white space, A-Z count as a-z; a
    text of fewer words is one shingle.  Null, empty and blank texts have no
    shingles and are linked with nothing, rows with a null key neither (their
    component is null).  Rows of one key are one document.  An empty table gives
    an empty result; other columns are not read.

    Equal sets are one representative from the start.  Links are exact; those
    missed are links whose signatures are further apart than ``DISTANCE``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    sketches = staged(sketched(rows, words), "sketches")
    reps = staged(sketches.filter("digest IS NOT NULL AND key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("id"), F.first("sig").alias("sig"), F.first("bits").alias("bits")), "reps")
    met = staged(buckets(reps), "buckets")
    few = met.select("id").distinct()
    sets = staged(full_sets(rows.join(few.withColumnRenamed("id", "key"), "key", "left_semi").repartition(n_tasks(spark)), words), "sets")

    first = _close(met.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")), reps)
    links = staged(_confirmed(first, sets, percent), "links")
    joined = components(links)

    # what is still apart in its bucket
    placed = met.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = staged(_open(placed.select("bucket", "id", "component")), "apart")
    able = staged(_with_partners(sets, apart.select("id").distinct(), percent), "able")
    able = staged(_with_partners(sets, able.select("id"), percent), "able")
    crossed = _crossing(_open(apart.select("bucket", "id", "component").join(able, "id")).join(reps.select("id", "sig", "bits"), "id"), percent).distinct()
    more = staged(_confirmed(crossed, sets, percent), "links")

    final = components(links.unionByName(more))
    of_rep = reps.select("digest", "id").join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    return sketches.join(of_rep, "digest", "left").select(
        "key", F.col("size").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component"))
