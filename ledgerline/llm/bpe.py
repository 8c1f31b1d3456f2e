"""Byte-level BPE in padded numpy matrices.

The distinct pieces of a chunk of texts, bucketed by length, are rows of
padded matrices of token ids.  In every round each row merges its leftmost
pair of minimum rank; the pair's rank comes from an open-addressing hash table,
and the row closes up over the merged place.  Rows without a pair leave.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: pieces of more bytes are merged one by one with a heap, for a round moves the whole row
LONG = 256

#: characters of text handled at once in a task
CHUNK = 2_000_000

NONE = np.iinfo(np.int32).max
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks as tables: bytes of each token, and rank of each pair that merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        pairs = {(a << 32) | b: rank for token, rank in ranks.items() for cut in range(1, len(token))
                 if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None}
        self.bits = max(4, (4 * len(pairs) or 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        left, mask = np.fromiter(pairs, np.int64, len(pairs)), (1 << self.bits) - 1
        values, slot = np.fromiter(pairs.values(), np.int32, len(pairs)), self._slot(left)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.ranks[slot[first]] = left[first], values[first]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left, values, slot = left[stay], values[stay], (slot[stay] + 1) & mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; ``NONE`` where it does not merge or an id is negative."""
        a, b = np.broadcast_arrays(a, b)
        out = np.full(a.shape, NONE, np.int32)
        at = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        keys = (a.ravel()[at].astype(np.int64) << 32) | b.ravel()[at]
        slot, mask, flat = self._slot(keys), (1 << self.bits) - 1, out.ravel()
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            flat[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there >= 0)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & mask
        return flat.reshape(a.shape)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of every piece."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            buckets.setdefault(len(p) if len(p) <= 16 else 1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in sorted(buckets.items()):
            if width > LONG:
                for i in rows:
                    out[i] = self._merge_long(pieces[i])
            elif width:
                step = max(1, 2_000_000 // width)
                for k in range(0, len(rows), step):
                    self._merge_matrix(pieces, rows[k:k + step], width, out)
        return out

    def _merge_matrix(self, pieces: list[bytes], rows: list[int], width: int, out: list[np.ndarray]) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
        size = np.array([len(pieces[i]) for i in rows])
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], -1).astype(np.int32)
        who = np.array(rows)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(who):
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(who), np.int64)
            low = ranks[np.arange(len(who)), best] if ranks.shape[1] else np.full(len(who), NONE)
            done = low == NONE
            if done.any():
                for i, row, n in zip(who[done].tolist(), ids[done], size[done].tolist()):
                    out[i] = row[:n].copy()
                on = ~done
                ids, ranks, who, size, best, low = ids[on], ranks[on], who[on], size[on], best[on], low[on]
                if not len(who):
                    return
            n, width = ids.shape
            at = np.arange(n)
            ids[at, best] = low
            keep = np.ones(ids.shape, bool)
            keep[at, best + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[at, best] = False
            ranks = ranks[keep].reshape(n, width - 2)
            size = size - 1
            left = best > 0
            ranks[at[left], best[left] - 1] = self.rank(ids[at[left], best[left] - 1], ids[at[left], best[left]])
            right = best < width - 2
            ranks[at[right], best[right]] = self.rank(ids[at[right], best[right]], ids[at[right], best[right] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of pairs over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].astype(np.int64).tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        lookup = lru_cache(65536)(lambda a, b: int(self.rank(np.array([a]), np.array([b]))[0]))

        def push(i: int, j: int) -> None:
            if (r := lookup(ids[i], ids[j])) != NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x, on in zip(ids, alive) if on], np.int32)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after the other, and the length of each."""
        size = self.lengths[ids]
        begin = np.cumsum(size) - size
        return self.blob[np.repeat(self.starts[ids] - begin, size) + np.arange(int(size.sum()))], size


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(4)
def _vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a})


@lru_cache(4)
def _pattern(text: str) -> regex.Pattern:
    return regex.compile(text)


def encode_texts(texts: list[str], vocabulary: Vocabulary, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and the number of each text's ids."""
    seen: dict[str, int] = {}
    which, pieces_of = [], []
    for text in texts:
        numbers = [seen.setdefault(p, len(seen)) for p in pattern.findall(text)]
        which.append(np.array(numbers, np.int64))
        pieces_of.append(len(numbers))
    merged = vocabulary.merge([p.encode("utf-8", "surrogatepass") for p in seen])
    size = np.array([len(m) for m in merged], np.int64)
    flat = np.concatenate(merged) if merged else np.empty(0, np.int32)
    start = np.cumsum(size) - size
    order = np.concatenate(which) if which else np.empty(0, np.int64)
    each = size[order]
    begin = np.cumsum(each) - each
    ids = flat[np.repeat(start[order] - begin, each) + np.arange(int(each.sum()))]
    ends = np.concatenate([[0], np.cumsum(each)])[np.cumsum(pieces_of)] if pieces_of else np.empty(0, np.int64)
    return ids, np.diff(ends, prepend=0)


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with about ``CHUNK`` characters or values in ``column`` at most, or one row."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        size = pc.binary_length(values) if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length(values)
        total = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(values):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
            yield batch.slice(at, end - at), values.slice(at, end - at)
            at = end


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), values], [*names, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the token ids of the text as ``out``, an array of int, last.

    Each match of ``pattern`` is encoded by itself, without special tokens; a
    null or empty text has no ids.  A column of that name is replaced, all
    others pass as they are.  ``ranks`` is the content of a rank file, which
    goes to the executors as it is (it does not grow with the data).  Works in
    one task per partition, in chunks of bounded size; a chunk holds at least
    one whole text.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def work(batches):
        vocabulary, compiled = _vocabulary(shared.value), _pattern(pattern)
        for batch, values in _chunks(batches, text):
            ids, size = encode_texts([t or "" for t in values.to_pylist()], vocabulary, compiled)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield _with(batch, out, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))

    return df.mapInArrow(work, _schema(df, out, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the token ids as ``out``, binary, last.  Null ids give empty bytes."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def work(batches):
        vocabulary = _vocabulary(shared.value)
        for batch, values in _chunks(batches, ids):
            data, each = vocabulary.decode(values.flatten().to_numpy(zero_copy_only=False))
            counts = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
            yield _with(batch, out, pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]))

    return df.mapInArrow(work, _schema(df, out, T.BinaryType()))
