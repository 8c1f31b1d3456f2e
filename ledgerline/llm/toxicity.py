"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, block-max index.

Vectors have all words of a text.  Words that one class of the examples has far
more often weigh more than the rest.  Labelled examples are held in blocks of
similar ones.  Of rare words the postings are summed for every example; of
common words a block keeps the largest weight of any of its examples, so a
query's sums and its weights times these maxima bound the cosine of everything
in the block.  Queries visit blocks in order of their bounds and leave out those
that cannot beat their k-th neighbour: the neighbours are exact.  Votes weighted
by similarity, and a calibration from the examples themselves, each scored
without itself, give the score; the neighbours are its evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import held_out, staged, whole_text

#: most labelled examples of each class in the index, taken in order of a hash of the key
EXAMPLES = 2_000

#: neighbours that vote, examples in a block, queries at once
NEIGHBOURS, BLOCK, QUERIES = 15, 64, 256

#: terms held as a table, the most common ones, and directions by which blocks are put together
COMMON, DIRECTIONS = 512, 4

#: blocks that a query visits before it leaves out any, and before it leaves out all that it can
VISITS = (4, 12)

#: chi-square of a term and the classes, and ratio of its shares in them, from which it weighs so many times as much
CHI_SQUARE, RATIO, MARKED = 20.0, 2.0, 10.0

#: parts of 1 in which squares are summed
FINE = float(2 ** 30)

_TOKEN = re.compile(r"[^\W_]+")


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def chosen_examples(labels: DataFrame, key: str, label: str, most: int = EXAMPLES) -> DataFrame:
    """``key, label, h, weight``: at most ``most`` of each class, and how many each stands for."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("key"))).distinct()
    sizes = known.groupBy("label").agg(F.count("*").alias("_n"))
    each = [known.filter(F.col("label") == c).withColumn("h", F.xxhash64("key")).orderBy("h", "key").limit(most) for c in (0, 1)]
    picked = each[0].unionByName(each[1])
    got = picked.groupBy("label").agg(F.count("*").alias("_got"))
    return picked.join(F.broadcast(sizes), "label").join(F.broadcast(got), "label").select("key", "label", "h", (F.col("_n") / F.col("_got")).alias("weight"))


def terms_of(texts: DataFrame) -> list[str]:
    """Every distinct term of ``text``, in order; for the bounded sample only."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column(0) for w in _tokens(t.as_py())}), pa.string())], ["term"])

    return sorted(r["term"] for r in texts.select("text").mapInArrow(work, "term string").distinct().collect())


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``row, key, ids, counts, rest`` of ``row, key, text``: how often the terms occur, by number, and the other words."""
    number = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    names = ["row", "key", "ids", "counts", "rest"]
    listed = lambda sizes, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                found: list[str] = []
                often: list[int] = []
                sizes = []
                for text in part.column(2).to_pylist():
                    counts = Counter(_tokens(text))
                    found += counts
                    often += counts.values()
                    sizes.append(len(counts))
                ids, n = np.fromiter(map(known.get, found, repeat(-1)), np.int32, len(found)), np.array(often, np.int32)
                new = ids < 0
                n_new = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[new], minlength=len(sizes))
                rest = pa.StructArray.from_arrays([pa.array([found[i] for i in np.flatnonzero(new)], pa.string()), pa.array(n[new])], ["word", "n"])
                n_ids = np.array(sizes) - n_new
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), listed(n_ids, pa.array(ids[~new])), listed(n_ids, pa.array(n[~new])), listed(n_new, rest)], names)

    return docs.select("row", "key", "text").mapInArrow(
        work, f"row long, key {docs.schema['key'].dataType.simpleString()}, ids array<int>, counts array<int>, rest array<struct<word: string, n: int>>")


def rest_squares(found: DataFrame, n: int) -> DataFrame:
    """``row, rest``: what the words that no example has add to a row's squared length.

    Sums are of whole numbers, so they do not depend on the order of rows.
    """
    each = found.select("row", F.explode("rest").alias("_w")).select("row", "_w.word", "_w.n")
    idf = each.groupBy("word").agg((F.log(F.lit(float(n + 1)) / (F.count("*") + 1)) + 1).alias("_idf"))
    square = F.pow((1 + F.log(F.col("n").cast("double"))) * F.col("_idf"), F.lit(2.0))
    return each.join(idf, "word").groupBy("row").agg((F.sum(F.round(square * FINE).cast("long")) / FINE).alias("rest"))


def _frequencies(found: DataFrame, terms: int) -> DataFrame:
    """``i, n``: in how many rows a term occurs, a row for each term and task."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["i", "n"])

    return found.select("ids").mapInArrow(work, "i int, n long")


@dataclass
class Rows:
    """Sparse rows: row r has ``ids[ptr[r]:ptr[r + 1]]`` and their weights."""

    ptr: np.ndarray
    ids: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    @classmethod
    def of(cls, matrix: np.ndarray) -> Rows:
        at, ids = np.nonzero(matrix)
        return cls(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(matrix)))]), ids, matrix[at, ids].astype(float))

    def of_row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ptr))

    def part(self, rows: np.ndarray) -> Rows:
        at, n = _stretches(self.ptr[rows], self.ptr[rows + 1])
        return Rows(np.concatenate([[0], np.cumsum(n)]), self.ids[at], self.weights[at])


def _stretches(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions start .. end-1 of every stretch, one after the other, and how many each has."""
    n = (end - start).astype(np.int64)
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n), n


def weighted(ids: list, counts: list, idf: np.ndarray) -> tuple[Rows, np.ndarray]:
    """Rows of (1 + log tf) * idf, made of unit length, and the squares of their lengths before."""
    ptr = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)]).astype(np.int64)
    flat = np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64)
    rows = Rows(ptr, flat, (1 + np.log(np.concatenate([np.empty(0), *counts]).astype(float))) * idf[flat])
    of = rows.of_row()
    square = np.bincount(of, rows.weights * rows.weights, len(rows)).astype(float)
    rows.weights = rows.weights / np.sqrt(square)[of]
    return rows, square


def dense(ids: list, counts: list, idf: np.ndarray) -> np.ndarray:
    """The rows of ``weighted`` as a matrix, for small tables."""
    rows, _ = weighted(ids, counts, idf)
    out = np.zeros((len(rows), len(idf)), np.float32)
    out[rows.of_row(), rows.ids] = rows.weights
    return out


def marks(ids: list, labels: np.ndarray, terms: int) -> np.ndarray:
    """Factor of every term: ``MARKED`` for those that one class has significantly more often, else 1."""
    of = np.repeat(labels, [len(i) for i in ids])
    flat = np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64)
    got, size = [np.bincount(flat[of == c], minlength=terms) for c in (0, 1)], [int((labels == c).sum()) for c in (0, 1)]
    if not all(size):
        return np.ones(terms)
    share, both = [g / n for g, n in zip(got, size)], (got[0] + got[1] + 1) / (len(labels) + 2)
    chi = (share[1] - share[0]) ** 2 / (both * (1 - both) * (1 / size[0] + 1 / size[1]))
    return np.where((chi > CHI_SQUARE) & (np.maximum(*share) > RATIO * np.minimum(*share)), MARKED, 1.0)


def _maxima(table: np.ndarray) -> np.ndarray:
    """The largest weight of each term in each block."""
    return table.reshape(len(table), table.shape[1] // BLOCK, BLOCK).max(2)


@dataclass
class Index:
    """Examples in blocks: common terms as a table with maxima by block, the others as postings.

    Position p holds example ``members[p]`` (-1: none), ``BLOCK`` positions make a
    block.  ``common`` is the row of a term in ``table`` and ``top``, or -1; the
    postings of any other term t are ``ptr[t]`` to the next pointer.
    """

    keys: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    members: np.ndarray
    common: np.ndarray
    table: np.ndarray
    top: np.ndarray
    ptr: np.ndarray
    place: np.ndarray
    weight: np.ndarray

    def __getstate__(self) -> dict:
        """The table without its zeros: the broadcast lies on every machine's disk."""
        at = np.flatnonzero(self.table)
        small = np.uint16 if len(self.members) < 1 << 16 else np.int32
        return self.__dict__ | {"table": (self.table.shape, at.astype(np.int32), self.table.ravel()[at]), "top": None, "place": self.place.astype(small)}

    def __setstate__(self, state: dict) -> None:
        shape, at, values = state["table"]
        table = np.zeros(shape)
        table.ravel()[at] = values
        self.__dict__.update(state | {"table": table, "top": _maxima(table), "place": state["place"].astype(np.int32)})

    @property
    def blocks(self) -> int:
        return len(self.members) // BLOCK

    @classmethod
    def of(cls, keys: np.ndarray, labels: np.ndarray, weights: np.ndarray, rows: Rows | np.ndarray, terms: int = 0) -> Index:
        terms = rows.shape[1] if isinstance(rows, np.ndarray) else max(terms, int(rows.ids.max(initial=-1)) + 1)
        rows = Rows.of(rows) if isinstance(rows, np.ndarray) else rows
        of = rows.of_row()
        chosen = np.argsort(-np.bincount(rows.ids, minlength=terms), kind="stable")[:COMMON]
        common = np.full(terms, -1, np.int32)
        common[chosen] = np.arange(len(chosen))
        rare = common[rows.ids] < 0
        each = np.zeros((len(rows), len(chosen)))
        each[of[~rare], common[rows.ids[~rare]]] = rows.weights[~rare]
        # like beside like: by label and by the main directions of the common terms (languages, say), so that maxima stay close to what a block holds
        centred = each - each.sum(0) / max(len(rows), 1)
        side = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -DIRECTIONS:]
        order = np.lexsort((side[:, -1], (side > 0) @ (1 << np.arange(side.shape[1])), labels)) if len(rows) else np.empty(0, np.int64)
        members = np.full(-(-len(order) // BLOCK) * BLOCK, -1)
        members[:len(order)] = order
        position = np.empty(len(order), np.int64)
        position[order] = np.arange(len(order))
        table = np.zeros((len(chosen), len(members)))
        table[:, position] = each.T
        place = position[of]
        by_term = np.flatnonzero(rare)[np.lexsort((place[rare], rows.ids[rare]))]
        ptr = np.concatenate([[0], np.cumsum(np.bincount(rows.ids[rare], minlength=terms))]).astype(np.int32)
        return cls(keys, labels, weights, members, common, table, _maxima(table), ptr, place[by_term].astype(np.int32), rows.weights[by_term])

    def nearest(self, queries: Rows | np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``NEIGHBOURS`` nearest examples of each query row and their cosines, ties by position.

        Only examples with a positive cosine count; places left over have
        cosine 0.  ``own`` names an example that each query must not find.
        Cosines are compared to twelve decimals.
        """
        queries = Rows.of(queries) if isinstance(queries, np.ndarray) else queries
        n, width, of = len(queries), len(self.members), queries.of_row()
        at = self.common[queries.ids]
        rare = at < 0
        common = np.zeros((n, len(self.table)))
        common[of[~rare], at[~rare]] = queries.weights[~rare]
        posting, many = _stretches(self.ptr[queries.ids[rare]], self.ptr[queries.ids[rare] + 1])
        # at least this much: rare terms everywhere, common ones where a block was visited
        least = np.bincount(np.repeat(of[rare] * width, many) + self.place[posting], np.repeat(queries.weights[rare], many) * self.weight[posting], n * width).astype(float).reshape(n, width)
        bounds = common @ self.top + least.reshape(n, -1, BLOCK).max(2)
        if own is not None:
            mine = np.argsort(self.members, kind="stable")[(self.members < 0).sum():][own]
        rank = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1)
        seen, kth = np.zeros(bounds.shape, bool), np.zeros(n)
        for visits in (*VISITS, self.blocks):
            visit = (rank < visits) & ~seen & (bounds > 0) & (bounds * 1.00001 >= kth[:, None])
            for b in np.flatnonzero(visit.any(0)):
                rows = np.flatnonzero(visit[:, b])
                least[rows, b * BLOCK:(b + 1) * BLOCK] += common[rows] @ self.table[:, b * BLOCK:(b + 1) * BLOCK]
            seen |= visit
            if own is not None:
                least[np.arange(n), mine] = 0
            kth = np.partition(least, width - NEIGHBOURS, axis=1)[:, width - NEIGHBOURS]
        row, at = np.nonzero((least > 0) & (least >= kth[:, None] - 1e-9))
        cosine, member = np.round(least[row, at], 12), self.members[at]
        order = np.lexsort((member, -cosine, row))
        row = row[order]
        turn = np.arange(len(row)) - np.searchsorted(row, row)
        first = turn < NEIGHBOURS
        who, best = np.full((n, NEIGHBOURS), -1), np.zeros((n, NEIGHBOURS))
        who[row[first], turn[first]], best[row[first], turn[first]] = member[order][first], cosine[order][first]
        return who, best

    def votes(self, who: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours, each by cosine and by the rows it stands for; -1 without any."""
        w = np.where(who >= 0, cosine * self.weights[who], 0)
        total = w.sum(1)
        return np.where(total > 0, (w * self.labels[who]).sum(1) / np.where(total > 0, total, 1), -1.0)


def calibration(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes and the score of each: shares of label 1, made to rise with the vote by pooling neighbours."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for i in order:
        if pools and pools[-1][3] == votes[i]:
            pools[-1][0] += weights[i] * labels[i]
            pools[-1][1] += weights[i]
        else:
            pools.append([weights[i] * labels[i], weights[i], votes[i], votes[i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    xs = np.array([x for p in pools for x in (p[2], p[3])])
    ys = np.array([p[0] / p[1] for p in pools for _ in (0, 1)])
    return xs, ys


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """``key, score, neighbours``, one row per row of ``docs``.

    ``neighbours`` is the evidence: ``key, label, cosine`` of the nearest
    examples, nearest first.  A text that shares no word with an example (a
    null or empty one too) has no neighbours and the score of such examples.  Without labels
    of both classes every score is the share of label 1, or 0.  Held out and
    null labels are not used.  Repeated rows have equal scores.

    The index is fitted on a bounded sample of labelled rows (``examples`` of
    each class) with all their words; document frequencies are of all documents,
    also of words that no example has: these count in a document's length.
    Words that one class of the examples has significantly more often weigh
    ``MARKED`` times as much in all vectors; no word is left out.  Every
    document is a query.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    picked = staged(chosen_examples(labels, key, label, examples), "examples")
    terms = terms_of(rows.join(F.broadcast(picked), "key"))
    found = staged(vectors(rows, terms), "vectors", "zstd")
    n = found.count()
    df = np.zeros(len(terms))
    for r in _frequencies(found, len(terms)).groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[r["i"]] = r["n"]
    idf = np.log((n + 1) / (df + 1)) + 1

    known = (found.select("key", "ids", "counts").join(F.broadcast(picked), "key").orderBy("h", "key", "label").dropDuplicates(["key", "label"])
             .limit(2 * examples).toPandas().sort_values(["h", "key", "label"]))
    idf *= marks(known["ids"].tolist(), known["label"].to_numpy(int), len(terms))
    matrix, _ = weighted(known["ids"].tolist(), known["counts"].tolist(), idf)
    index = Index.of(known["key"].to_numpy(), known["label"].to_numpy(int), known["weight"].to_numpy(float), matrix, len(terms))
    steps = [np.arange(at, min(at + QUERIES, len(matrix))) for at in range(0, len(matrix), QUERIES)]
    own = np.concatenate([index.votes(*index.nearest(matrix.part(at), at)) for at in steps]) if steps else np.empty(0)
    xs, ys = calibration(own, index.labels, index.weights) if len(own) else (np.array([-1.0]), np.array([0.0]))
    shared = spark.sparkContext.broadcast((index, idf, xs, ys))  # bounded by the sample and the terms
    kind = docs.schema[key].dataType.simpleString()
    evidence = f"array<struct<key: {kind}, label: int, cosine: double>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, idf, xs, ys = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                cuts = np.cumsum(part.column(2).value_lengths().to_numpy(zero_copy_only=False))[:-1]
                ids, counts = (np.split(part.column(i).flatten().to_numpy(zero_copy_only=False), cuts) for i in (2, 3))
                queries, square = weighted(ids, counts, idf)
                who, cosine = index.nearest(queries) if index.blocks else (np.full((len(ids), 1), -1), np.zeros((len(ids), 1)))
                votes = index.votes(who, cosine) if index.blocks else np.full(len(ids), -1.0)
                # the vote itself tells apart what the calibration pools
                score = np.clip(0.99 * np.interp(votes, xs, ys) + 0.01 * np.maximum(votes, 0), 0, 1)
                some = who >= 0
                found = [pa.array(index.keys[who[some]], part.schema.field(1).type), pa.array(index.labels[who[some]], pa.int32()), pa.array(cosine[some], pa.float64())]
                seen = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some.sum(1))]), pa.int32()), pa.StructArray.from_arrays(found, ["key", "label", "cosine"]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array(square, pa.float64()), seen], ["row", "key", "score", "square", "seen"])

    # words that no example has shorten all cosines of a row alike, so they are looked up after the search
    answers = found.select("row", "key", "ids", "counts").mapInArrow(work, f"row long, key {kind}, score double, square double, seen {evidence}")
    share = F.sqrt(F.col("square") / (F.col("square") + F.coalesce("rest", F.lit(0.0))))
    return answers.join(rest_squares(found, n), "row", "left").select(
        "key", "score", F.transform("seen", lambda x: F.struct(x["key"].alias("key"), x["label"].alias("label"), (x["cosine"] * share).alias("cosine"))).alias("neighbours"))
