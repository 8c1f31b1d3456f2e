"""Vector codes against a plain search of all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from ledgerline.llm import vector_codes as vc
from ledgerline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, `key` string, q string, d string, code string, error string, x string"


def _table(spark, rows):
    return spark.createDataFrame([(k, v, lab, *"abcdef") for k, v, lab in rows], SCHEMA)


def _plain(rows, rounds=2):
    """Codes of kept rows in order of key, components as Python integers."""
    bad = lambda v: v is None or not v or any(x is None or not math.isfinite(x) for x in v)
    kept = sorted(((k, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for k, v, lab in rows if not bad(v)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // 16
    parts = [[q[k * w:(k + 1) * w] for k in range(16)] for _, _, q in kept]
    books = [[p[k] for p in parts[:64]] for k in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for k in range(16):
            at = [near(p[k], books[k])[1] for p in parts]
            for j in set(at):
                mine = [p[k] for p, a in zip(parts, at) if a == j]
                new[k][j] = [sum(c) // len(mine) for c in zip(*mine)]
        books = new
    out = []
    for (key, lab, _), p in zip(kept, parts):
        found = [near(p[k], books[k]) for k in range(16)]
        out.append([key, lab, bytes(j for _, j in found), sum(d for d, _ in found)])
    for r in out:
        r.append(sum(x[3] for x in out if x[1] == r[1]))
    return sorted(map(tuple, out), key=str), books


def _rows(n=300, dims=32, seed=5):
    rng = random.Random(seed)
    rows = [(i * 3, [rng.gauss(0, 0.2) for _ in range(dims)], rng.choice([0, 0, 1, None])) for i in range(n)]
    rows += [(9, list(rows[3][1]), 1), (9, list(rows[3][1]), 1), (9, list(rows[4][1]), None)]  # repeated rows and keys
    rows += [(2000 + i, [0.5 if i % 2 else -0.5] * dims, 7) for i in range(150)]  # a hot vector, ties
    return rows + [(None, [rng.gauss(0, 0.2) for _ in range(dims)], 2), (5001, None, 1), (5002, [], 1), (5003, [0.1] * (dims - 1) + [None], 1), (5004, [float("nan")] + [0.1] * (dims - 1), 1),
                   (5005, [float("inf")] + [0.1] * (dims - 1), None)]


@pytest.mark.parametrize("n", [300, 20])
def test_codes(spark, n):
    rows = _rows(n)
    got, books = vc.compressed(_table(spark, rows))
    want, plain = _plain(rows)
    assert sorted(((r["key"], r["label"], bytes(r["code"]), r["error"], r["label_error"]) for r in got.collect()), key=str) == want
    assert books.tolist() == plain


def test_odd_tables(spark):
    got, books = vc.compressed(_table(spark, []))
    assert got.columns == ["key", "label", "code", "error", "label_error"] and got.count() == 0 and books.shape == (16, 0, 0)
    assert vc.compressed(_table(spark, [(1, None, 1), (2, [1.0] * 15, 1)]))[0].count() == 0
    # the length of the smallest key counts; huge components are kept within bounds
    got, _ = vc.compressed(_table(spark, [(1, [0.25] * 16, 1), (0, [1.0] * 17, 1), (2, [0.25] * 32, 1), (3, [3e38] * 16, 2), (4, [-3e38] * 16, 2)]))
    assert sorted((r["key"], r["error"]) for r in got.collect()) == [(1, 0), (3, 0), (4, 0)]
    assert [r["error"] for r in vc.compressed(_table(spark, [(None, [0.5] * 16, None)]))[0].collect()] == [0]


@pytest.mark.parametrize("scale", [3, 1000, vc.limit(64)])
def test_bounds_lose_nothing(scale):
    rng = np.random.default_rng(7)
    x, entries = rng.integers(-scale, scale, (400, 4)), rng.integers(-scale, scale, (64, 4))
    entries[9] = entries[3]
    x[:40] = entries[rng.integers(0, 64, 40)]
    pivots = vc.chosen_pivots(entries, vc.PIVOTS)
    at, best, tried = vc.nearest(x, vc.distances(x, pivots).astype(np.float32), entries, vc.distances(entries, pivots))
    plain = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (best == plain.min(1)).all() and (at == plain.argmin(1)).all()
    assert tried < 0.7 * plain.size


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op11_vector_codes"](spark, folder)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, books = _plain(rows)
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((k, code.hex(), error, of_label, digest) for k, _, code, error, of_label in want), key=str)
