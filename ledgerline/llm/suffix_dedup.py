"""Long repeats across a corpus, by run-length indexes of what may repeat.

A byte falls if a string of ``LEAST`` bytes that covers it also starts anywhere
else.  Every string of that length has an anchor: its leftmost minimal k-gram
by hash.  Equal strings have equal anchors, so the strings of a text are cut
into segments by anchor, and only segments that share an anchor can match.
Equal segments match as a whole and are counted by digest.  Different segments
of one anchor are indexed together: a Burrows-Wheeler transform in runs, with
the text positions of the run ends and what they have in common with their
neighbours.  From these samples the longest match of every position with any
other place follows in one pass over the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import n_tasks, staged, whole_text

#: bytes of a repeat, and of the k-gram that anchors it
LEAST, GRAM = 400, 100

#: windows that compete for an anchor
PLACES = LEAST - GRAM + 1

#: different segments of one anchor up to which they are indexed together; beyond, their strings are counted by digest
TOGETHER = 2_000

#: bytes indexed at once, and symbols packed into the first key of the suffix sort
INDEXED, PACKED = 1_000_000, 7

#: bytes of a text that are cut into segments at once
STRETCH = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = STRETCH + LEAST + 1
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))]))
    return up, back


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the k-gram at each place: a rolling sum of powers, well mixed."""
    up, back = _powers()
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])
    h = (total[GRAM:] - total[:-GRAM]) * back[:len(data) - GRAM + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _leftmost_minimum(h: np.ndarray) -> np.ndarray:
    """Place of the minimum among each ``PLACES`` values in a row, the leftmost of equal ones."""
    n = len(h) - PLACES + 1
    size = -(-len(h) // PLACES) * PLACES
    keys = np.full(size, np.iinfo(np.uint64).max)
    keys[:len(h)] = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)  # places fit in 20 bits
    blocks = keys.reshape(-1, PLACES)
    to_here = np.minimum.accumulate(blocks, 1).ravel()
    from_here = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(from_here[:n], to_here[PLACES - 1:PLACES - 1 + n])
    return (least & np.uint64((1 << 20) - 1)).astype(np.int64)


def segments(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """``start, windows, anchor, digest`` of each run of windows with one anchor.

    A segment of w windows is the w + LEAST - 1 bytes from its start; every
    window of the text is in one segment.
    """
    for begin in range(0, max(len(data) - LEAST + 1, 0), STRETCH):
        part = np.frombuffer(data[begin:begin + STRETCH + LEAST - 1], np.uint8)
        h = _grams(part)
        anchor = _leftmost_minimum(h)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(first, len(anchor)))
        names = h[anchor[first]].view(np.int64)
        for a, n, name in zip((first + begin).tolist(), count.tolist(), names.tolist()):
            yield a, n, name, xxhash.xxh3_128_digest(data[a:a + n + LEAST - 1])


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of several strings, with sampled run ends.

    ``symbols`` and ``heads`` are the runs; ``starts`` and ``ends`` hold, for
    the first and last row of every run, the text position and how much it has
    in common with the row before or after.
    """

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        n = int((sizes + 1).sum())
        text = np.zeros(n, np.int64)
        text[self.begin + sizes] = np.arange(len(parts))  # every string ends in a symbol of its own
        inside = np.ones(n, bool)
        inside[self.begin + sizes] = False
        text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + len(parts)
        self.n = n
        self._sort(text)
        before = text[self.order - 1]
        change = np.flatnonzero(before[1:] != before[:-1])
        self.heads = np.concatenate([[0], change + 1])
        self.symbols = before[self.heads]
        last = np.append(change, n - 1)
        up, down = self.heads[1:], last[:-1]
        self.starts = (self.order[up], self._common(self.order[up], self.order[up - 1]))
        self.ends = (self.order[down], self._common(self.order[down], self.order[down + 1]))

    def _sort(self, text: np.ndarray) -> None:
        """Suffix order by doubling; the ranks of each length stay for comparisons."""
        wide = int(text.max()) + 2
        key, packed = np.zeros(self.n, np.int64), 0
        while packed < PACKED and wide ** (packed + 1) < 2**62:
            key *= wide
            key[:max(self.n - packed, 0)] += text[packed:] + 1
            packed += 1
        self.levels, length = [], packed
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank_of = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            rank = np.empty(self.n, np.int64)
            rank[order] = rank_of
            self.levels.append((length, rank))
            if rank_of[-1] == self.n - 1:
                break
            key = (rank + 1) * (self.n + 1)
            key[:max(self.n - length, 0)] += rank[length:] + 1
            length *= 2
        self.order, self.text = order, text

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of each two positions."""
        out = np.zeros(len(a), np.int64)
        same = lambda values, at: (a + out < self.n) & (b + out < self.n) & (values[np.minimum(a + out, self.n - 1)] == values[np.minimum(b + out, self.n - 1)]) & at
        for length, rank in reversed(self.levels):
            out += length * same(rank, True)
        on = np.ones(len(a), bool)
        for _ in range(self.levels[0][0]):
            on = same(self.text, on)
            if not on.any():
                break
            out += on
        return out

    def matching(self) -> np.ndarray:
        """Longest match of every position with another one.

        A position whose row does not begin a run has one symbol less in common
        with its neighbour than the position before it; so the samples, carried
        along the text, give all lengths.
        """
        out = np.zeros(self.n, np.int64)
        for position, common in (self.starts, self.ends):
            reach = np.zeros(self.n, np.int64)
            reach[position] = position + common
            np.maximum(out, np.maximum.accumulate(reach) - np.arange(self.n), out=out)
        return out

    def repeated(self) -> list[np.ndarray]:
        """For every string, the starts of substrings of ``LEAST`` that are somewhere else too."""
        long_ = np.flatnonzero(self.matching() >= LEAST)
        cuts = np.searchsorted(long_, self.begin[1:])
        return [x - b for x, b in zip(np.split(long_, cuts), self.begin)]


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers: first and last."""
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x) > 1)
    return list(zip(x[np.concatenate([[0], cut + 1])].tolist(), x[np.append(cut, len(x) - 1)].tolist()))


def _cut(texts: DataFrame) -> DataFrame:
    """``doc, start, windows, anchor, digest`` of ``doc, text``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(d, *s) for d, t in zip(part.column(0).to_pylist(), part.column(1)) for s in segments(t.as_py().encode("utf-8", "surrogatepass"))]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
                                                      pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], ["doc", "start", "windows", "anchor", "digest"])

    return texts.mapInArrow(work, "doc binary, start int, windows int, anchor long, digest binary")


def _contents(texts: DataFrame) -> DataFrame:
    """``anchor, digest, content`` of ``text, wanted``: the bytes of each wanted segment."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for text, wanted in zip(part.column(0), part.column(1)):
                    data = text.as_py().encode("utf-8", "surrogatepass")
                    rows += [(w["anchor"], w["digest"], data[w["start"]:w["start"] + w["windows"] + LEAST - 1]) for w in wanted.as_py()]
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["anchor", "digest", "content"])

    return texts.mapInArrow(work, "anchor long, digest binary, content binary")


def _indexed(contents: DataFrame) -> DataFrame:
    """``anchor, digest, first, last``: runs of windows that repeat, segments of one anchor indexed together."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            rows = [(a, d, *run) for (a, d, _), x in zip(held, RunIndex([c for _, _, c in held]).repeated()) for run in _runs(x)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int32()))], ["anchor", "digest", "first", "last"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if total > INDEXED and held[-1][0] != row[0]:
                    yield flush()
                    held, total = [], 0
                held.append(row)
                total += len(row[2])
        if held:
            yield flush()

    return contents.mapInArrow(work, "anchor long, digest binary, first int, last int")


def _counted(contents: DataFrame) -> DataFrame:
    """As ``_indexed``, for anchors with very many segments: every string counted by digest, spread over all tasks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, d, c in zip(*(x.to_pylist() for x in batch.columns)):
                n = len(c) - LEAST + 1
                yield pa.RecordBatch.from_arrays([pa.array([a] * n, pa.int64()), pa.array([d] * n, pa.binary()), pa.array(range(n), pa.int32()),
                                                  pa.array([xxhash.xxh3_128_digest(c[i:i + LEAST]) for i in range(n)], pa.binary())], ["anchor", "digest", "first", "string"])

    each = contents.mapInArrow(work, "anchor long, digest binary, first int, string binary")
    often = each.groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
    return each.join(often, "string", "left_semi").select("anchor", "digest", "first", F.col("first").alias("last"))


def _removed(texts: DataFrame) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept`` of ``key, text, spans``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data, kept, at, gone, runs = text.as_py().encode("utf-8", "surrogatepass"), [], 0, 0, 0
                end = -1
                for s in sorted((s["a"], s["b"]) for s in (spans.as_py() or [])):
                    if s[0] > end:
                        runs += 1
                        kept.append(data[at:s[0]])
                        end = at = s[0]
                    if s[1] > end:
                        gone += s[1] - end
                        end = at = s[1]
                out.append((len(data), gone, runs, b"".join([*kept, data[at:]])))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["key", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(work, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept``, one row per row of ``docs``.

    Texts are UTF-8 bytes, null as empty; matches do not cross documents but
    may lie in one, and may overlap.  Every copy of a repeat falls; what falls
    is judged on the input.  Texts shorter than ``LEAST`` bytes stay.  Repeated
    rows are texts like others, so long ones fall whole.  Null keys pass
    through.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).withColumn("doc", F.unhex(F.md5(F.col("text").cast("binary"))))
    long_ = rows.filter(F.octet_length("text") >= LEAST).select("doc", "text")
    cut = staged(_cut(long_), "segments")

    # one row per different segment of an anchor: how often, and where first
    cells = staged(cut.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start", "windows")).alias("at"))
                   .select("anchor", "digest", "n", "at.*"), "cells")
    several = cells.groupBy("anchor").agg(F.count("*").alias("different")).filter("different > 1")
    wanted = cells.join(several, "anchor")
    of_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "digest", "start", "windows")).alias("wanted"))
    some = long_.groupBy("doc").agg(F.first("text").alias("text")).join(of_doc, "doc")
    contents = staged(_contents(some.select("text", "wanted")), "contents").join(several, "anchor")
    together = contents.filter(F.col("different") <= TOGETHER).select("anchor", "digest", "content").repartition(n_tasks(spark), "anchor").sortWithinPartitions("anchor")
    apart = contents.filter(F.col("different") > TOGETHER).select("anchor", "digest", "content").repartition(n_tasks(spark))
    partial = _indexed(together).unionByName(_counted(apart))

    # equal segments fall whole wherever they are; parts of the others where they are once
    whole = cut.join(cells.filter("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select(
        "doc", F.col("start").alias("a"), (F.col("start") + F.col("windows") + LEAST - 1).alias("b"))
    parts = partial.join(cells.filter("n = 1").select("anchor", "digest", "doc", "start"), ["anchor", "digest"]).select(
        "doc", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + LEAST).alias("b"))
    spans = whole.unionByName(parts).distinct().groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return _removed(rows.join(spans, "doc", "left").select("key", "text", "spans"))
