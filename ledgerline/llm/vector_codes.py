"""Product codes of vectors: each part is replaced by its nearest codebook entry, found by LAESA pivots.

The distances of all parts to a few fixed pivots are computed once and stored
with the vectors.  In each round only the entries' distances to the pivots are
new; by the triangle inequality their differences bound from below how far a
part is from an entry.  Entries are tried in order of these bounds, in exact
integers, until the next bound is above the best distance found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256

#: pivots of each part position
PIVOTS = 4

#: vectors handled at once by a task
BATCH = 2_048

#: relative slack of a bound, above the rounding of stored distances (32-bit floats)
SLACK = 2.0**-21


def limit(dims: int) -> int:
    """Largest size of a component; those beyond (``x`` of 2**19 and more at 64 dimensions) are set to it, so that an error fits 64 bits."""
    return 1 << ((62 - math.ceil(math.log2(dims))) // 2 - 1)


def chosen_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """Of the first entries of a part some that lie far apart: each next one is furthest from those before."""
    picked = [0]
    gap = ((entries - entries[0]) ** 2).sum(1)
    while len(picked) < min(n, len(entries)):
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((entries - entries[picked[-1]]) ** 2).sum(1))
    return entries[picked]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of ``x`` to each of ``y``."""
    return np.sqrt(np.stack([((x - p) ** 2).sum(1) for p in y], axis=1).astype(np.float64))


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each row, its squared distance, and how many distances that took; ties to the lower index."""
    bound = np.zeros((len(x), len(entries)))
    for p in range(to_pivots.shape[1]):
        d, e = to_pivots[:, p, None].astype(np.float64), entry_to_pivots[None, :, p]
        np.maximum(bound, np.abs(d - e) - SLACK * (d + e), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1) ** 2
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))
    rows, tried = np.arange(len(x)), 0
    for t in range(len(entries)):
        rows = rows[bound[rows, t] <= best[rows]]
        if not len(rows):
            break
        j = order[rows, t]
        d = ((x[rows] - entries[j]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
        best[rows[better]], at[rows[better]] = d[better], j[better]
        tried += len(rows)
    return at, best, tried


def _numbers(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


class _Books:
    """Entries of all part positions, ``(PARTS, entries, width)``, and their distances to the fixed pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray) -> None:
        self.entries, self.width = entries, entries.shape[2]
        self.to_pivots = np.stack([distances(e, p) for e, p in zip(entries, pivots)])

    def assigned(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Slices of a batch of ``q, d`` with their parts, codes and squared distances by part."""
        for i in range(0, batch.num_rows, BATCH):
            part = batch.slice(i, BATCH)
            q = _numbers(part.column("q"), part.num_rows).astype(np.int64).reshape(part.num_rows, PARTS, self.width)
            d = _numbers(part.column("d"), part.num_rows).reshape(part.num_rows, PARTS, -1)
            found = [nearest(q[:, k], d[:, k], self.entries[k], self.to_pivots[k]) for k in range(PARTS)]
            yield part, q, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``key, label, q, d``: the parts' distances to the pivots, computed once."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _numbers(batch.column("q"), batch.num_rows).astype(np.int64).reshape(batch.num_rows, PARTS, -1)
            d = np.stack([distances(q[:, k], pivots[k]) for k in range(PARTS)], axis=1).astype(np.float32).reshape(batch.num_rows, -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * d.shape[1]), pa.array(d.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "label", "q")), lists], ["key", "label", "q", "d"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(work, f"key {kinds['key']}, label {kinds['label']}, q array<int>, d array<float>")


def _means(vectors: DataFrame, books: _Books) -> np.ndarray:
    """The next entries: floored means of the parts assigned to each; unused ones stay.

    A task sends one row for each component of an entry that it used, which
    Spark adds up; the driver gets no more rows than the codebooks have numbers.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(books.entries.shape[:2], np.int64)
        total = np.zeros(books.entries.shape, np.int64)
        for batch in batches:
            for _, q, codes, _ in books.assigned(batch):
                for k in range(PARTS):
                    n[k] += np.bincount(codes[:, k], minlength=n.shape[1])
                    np.add.at(total[k], codes[:, k], q[:, k])
        part, entry = np.nonzero(n)
        sizes = np.repeat(n[part, entry], books.width)
        at = [np.repeat(part, books.width), np.repeat(entry, books.width), np.tile(np.arange(books.width), len(part))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(sizes), pa.array(total[part, entry].reshape(-1))], ["part", "entry", "at", "n", "total"])

    sums = vectors.select("q", "d").mapInArrow(work, "part long, entry long, at long, n long, total long")
    entries = books.entries.copy()
    for r in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        entries[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return entries


def _coded(vectors: DataFrame, books: _Books) -> DataFrame:
    """``key, label, code, error``: the codes as bytes and the squared distances added up."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, codes, squares in books.assigned(batch):
                rows = codes.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(squares.sum(1))],
                                                 ["key", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(work, f"key {kinds['key']}, label {kinds['label']}, code binary, error long")


def compressed(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """``key, label, code, error, label_error`` of each kept row, and the codebooks ``(PARTS, entries, width)``.

    Components are floored to integers at ``SCALE``.  Codebooks start as the
    vectors of the ``ENTRIES`` smallest keys and take ``ROUNDS`` rounds.  A code
    has a byte for each part; ``error`` is the sum of the parts' squared
    distances, ``label_error`` its sum over all rows of the label, null labels
    together (null if beyond 64 bits).

    Rows whose vector is null, empty or holds null or non-finite components are
    dropped, and those whose length is not that of the kept row of the smallest
    key with a multiple of ``PARTS``.  Rows with a null key are coded, and
    start a codebook only where other keys do not suffice.  Repeated rows are
    coded each; equal keys are ordered by their components.  Components are
    kept within ``limit``.  An empty table gives an empty result and no entries.
    Other columns are not read.
    """
    spark = table.sparkSession
    x = F.col(vector).cast("array<double>")
    rows = table.select(F.col(key).alias("key"), F.col(label).alias("label"), x.alias("x"))
    good = rows.filter(F.coalesce((F.size("x") > 0) & (F.size("x") % PARTS == 0) & F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))), F.lit(False)))
    first = good.select(F.struct(F.col("key").isNull(), "key", F.size("x").alias("dims")).alias("s")).agg(F.min("s").alias("s")).first()["s"]
    if first is None:
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        return spark.createDataFrame([], f"key {kinds['key']}, label {kinds['label']}, code binary, error long, label_error long"), np.empty((PARTS, 0, 0), np.int64)
    dims = first["dims"]
    most = limit(dims)
    whole = F.transform("x", lambda v: F.floor(F.least(F.greatest(v * float(SCALE), F.lit(float(-most))), F.lit(float(most)))).cast("int"))
    vectors = good.filter(F.size("x") == dims).select("key", "label", whole.alias("q"))
    seeds = np.array([r["q"] for r in vectors.orderBy(F.col("key").asc_nulls_last(), "q").select("q").limit(ENTRIES).collect()], np.int64)
    entries = seeds.reshape(len(seeds), PARTS, dims // PARTS).transpose(1, 0, 2).copy()
    pivots = [chosen_pivots(e, PIVOTS) for e in entries]
    stored = staged(_with_pivots(vectors, pivots), "parts")
    for _ in range(ROUNDS):
        entries = _means(stored, _Books(entries, pivots))
    coded = staged(_coded(stored, _Books(entries, pivots)), "codes")
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")).withColumnRenamed("label", "_label")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").select("key", "label", "code", "error", "label_error")
    return out, entries
