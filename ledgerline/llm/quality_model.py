"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in a cycle; each turn fits a shallow tree on
one feature's bins and adds its leaves to that feature's lookup table.  Then
the pairs that explain most of what is left get small two-way tables in the
same way.  A row's score is the logistic of a sum of table entries, found by
binning whole columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import held_out, staged
from ledgerline.llm.features import RATIOS, counted, ratios

#: most labelled rows that the model is fitted on, taken in order of a hash of the key
SAMPLE = 20_000

BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE, SMOOTH = 300, 0.1, 5.0

#: rounds without a gain on the rows kept back after which boosting ends
PATIENCE = 20


@dataclass
class Model:
    """Edges of the bins and tables of each feature, tables of pairs, and the intercept."""

    features: list[str]
    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j])]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_edges[i], x[:, i]), np.searchsorted(self.pair_edges[j], x[:, j])]
        return _logistic(total)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _edges(x: np.ndarray, y: np.ndarray, bins: int) -> np.ndarray:
    """Edges between bins: quantiles of each class, and the middles of gaps."""
    at = np.linspace(0, 1, bins // 2 + 1)
    marks = np.unique(np.concatenate([np.quantile(x[y == c], at) for c in (0, 1)]))
    return (marks[1:] + marks[:-1]) / 2


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf value of each bin in a tree over ordered bins: best split first."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + SMOOTH)
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (a, b), int(cut[k]))
        if best[1] is None:
            break
        (a, b), c = best[1], best[2]
        parts = [p for p in parts if p != (a, b)] + [(a, c), (c, b)]
    out = np.empty(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + SMOOTH)
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut in both directions of a two-way table: its worth, and the leaf value of each cell."""
    g, h = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (gradient, weight))
    n, m = gradient.shape
    best, out = 0.0, np.zeros_like(gradient)
    for a in range(1, n):
        for b in range(1, m):
            boxes = [(0, a, 0, b), (0, a, b, m), (a, n, 0, b), (a, n, b, m)]
            sums = [(t[r, s] - t[q, s] - t[r, p] + t[q, p]) for q, r, p, s in boxes for t in (g, h)]
            values = [x / (w + SMOOTH) for x, w in zip(sums[::2], sums[1::2])]
            worth = sum(x * v for x, v in zip(sums[::2], values))
            if worth > best:
                best = worth
                for (q, r, p, s), v in zip(boxes, values):
                    out[q:r, p:s] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray, back: np.ndarray, features: Sequence[str]) -> Model:
    """A model of ``y`` (0 or 1) by ``x``; rows marked ``back`` only tell when to stop.

    Without rows of both classes the score is the share of label 1 (one half
    without rows).
    """
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    model = Model(list(features), [np.empty(0)] * len(features), start, [np.zeros(1) for _ in features])
    if len(np.unique(y[~back])) < 2:
        return model
    model.edges = [_edges(x[~back, j], y[~back], BINS) for j in range(x.shape[1])]
    model.pair_edges = [_edges(x[~back, j], y[~back], PAIR_BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), start)

    def boost(turns) -> None:
        """Go round ``turns`` until the rows kept back gain nothing; each changes ``total``."""
        nonlocal total
        loss = lambda: float(np.logaddexp(0, np.where(y == 1, -total, total))[back].mean()) if back.any() else 0.0
        best, since = loss(), 0
        for _ in range(ROUNDS):
            for turn in turns:
                p = _logistic(total)
                total = total + turn((y - p) * ~back, p * (1 - p) * ~back)
            now = loss()
            best, since = (now, 0) if now < best - 1e-6 else (best, since + 1)
            if back.any() and since >= PATIENCE:
                break

    def single(j: int):
        def turn(g, h):
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            model.tables[j] += step
            return step[bins[j]]
        return turn

    boost([single(j) for j in range(x.shape[1])])
    p = _logistic(total)
    g, h = (y - p) * ~back, p * (1 - p) * ~back
    coarse = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.pair_edges)]
    shape = [len(e) + 1 for e in model.pair_edges]
    cells = lambda i, j, v: np.bincount(coarse[i] * shape[j] + coarse[j], v, shape[i] * shape[j]).reshape(shape[i], shape[j])
    worth = sorted(((-_quadrants(cells(i, j, g), cells(i, j, h))[0], i, j) for i in range(len(shape)) for j in range(i)))[:PAIRS]
    model.pairs = [(i, j) for w, i, j in worth if w < 0]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]

    def double(k: int):
        i, j = model.pairs[k]

        def turn(g, h):
            step = RATE * _quadrants(cells(i, j, g), cells(i, j, h))[1]
            model.pair_tables[k] += step
            return step[coarse[i], coarse[j]]
        return turn

    if model.pairs:
        boost([double(k) for k in range(len(model.pairs))])
    # tables with mean zero over the rows, the rest in the intercept
    for j, b in enumerate(bins):
        mean = float(model.tables[j][b].mean())
        model.tables[j] -= mean
        model.intercept += mean
    return model


def learned(features: DataFrame, labels: DataFrame, key: str, label: str, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` of the labelled rows that are not held out, those first by a hash of the key."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("key")))
    chosen = known.withColumn("_h", F.xxhash64("key")).orderBy("_h", "key", "label").limit(sample)
    rows = features.join(F.broadcast(chosen), "key").select("_h", "label", *RATIOS).orderBy("_h", "label").limit(sample).toPandas()
    h, y = rows["_h"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
    return fit(rows[list(RATIOS)].to_numpy(float), y, h % 5 == 0, RATIOS)


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``key, score``, one row per row of ``docs``: probability of label 1.

    Reads only the text; a null text counts as empty and has a score too.
    Repeated rows have equal scores.  Labels of held out keys and null labels
    are not used.
    """
    features = staged(counted(docs, key, text).select("key", *(c.alias(n) for n, c in ratios().items())), "features")
    model = learned(features, labels, key, label)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "score": model.scores(f[list(RATIOS)].to_numpy(float))})

    return features.mapInPandas(work, f"key {features.schema['key'].dataType.simpleString()}, score double")
