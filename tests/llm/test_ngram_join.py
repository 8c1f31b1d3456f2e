"""The n-gram join against comparing all pairs."""

import random

import numpy as np
import pytest

from ledgerline.llm import ngram_join as nj
from ledgerline.llm.queries import QUERIES
from tests.llm import brute, data


def _check(spark, rows, **options):
    got = nj.joined_groups(data.table(spark, rows), **options).collect()
    assert len(got) == len(rows)
    want = brute.near({k: t for k, t, _ in rows if k is not None}, options.get("words", nj.WORDS))
    assert {r["key"]: (r["n_shingles"], r["component"]) for r in got if r["key"] is not None} == want
    nulls = sorted((len(brute.shingle_set(t, options.get("words", nj.WORDS))), None) for k, t, _ in rows if k is None)
    assert sorted((r["n_shingles"], r["component"]) for r in got if r["key"] is None) == nulls


def test_odd_rows(spark):
    _check(spark, [*data.odd_rows(), (None, "one", "a"), (None, "no key at all", "a"), (None, "no key at all", "a")])


@pytest.mark.parametrize("seed", range(2))
def test_links_near_the_threshold(spark, monkeypatch, seed):
    monkeypatch.setattr(nj, "STRIPE", 8)
    monkeypatch.setattr(nj, "RANGE", 3_000)
    rng = random.Random(seed)
    rows = []
    for group in range(12):
        body = data.prose(rng, rng.choice([6, 30, 120, 240])).split()
        for _ in range(10):
            w = list(body)
            for _ in range(rng.randint(0, max(1, len(w) // 22))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
            rows.append((len(rows) * 7 % 997, " ".join(w + data.prose(rng, rng.randint(0, 8)).split()), "a"))
    _check(spark, rows)


def test_templates_that_share_much_but_do_not_link(spark, monkeypatch):
    """One long passage in all: every token of it is in the prefix of many sets, which are left to the stripes."""
    monkeypatch.setattr(nj, "STRIPE", 8)
    rng = random.Random(9)
    passage = data.prose(rng, 160)
    rows = [(i, passage + " " + data.prose(rng, 25 + i % 20), "a") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", "a") for i in range(0, 60, 5)]
    _check(spark, rows)


def test_chains_and_equal_sets(spark):
    rng = random.Random(3)
    words = data.prose(rng, 100).split()
    rows = []
    for i in range(30):
        rows += [(i, " ".join(words), "a"), (500 + i, " ".join(words).upper(), "b")]
        words = words[4:] + data.prose(rng, 4).split()
    _check(spark, rows)


def test_empty_table_and_repeated_keys(spark):
    got = nj.joined_groups(data.table(spark, []))
    assert got.columns == ["key", "n_shingles", "component"] and got.count() == 0
    rng = random.Random(5)
    a, b = data.prose(rng, 50), data.prose(rng, 40)
    got = nj.joined_groups(data.table(spark, [(7, a, "a"), (7, b, "a"), (7, b, "a"), (9, b, "a"), (8, a + " more", "a")])).collect()
    assert sorted((r["key"], r["n_shingles"], r["component"]) for r in got) == [(7, 36, 7), (7, 36, 7), (7, 46, 7), (8, 47, 7), (9, 36, 7)]


def test_prefixes_share_a_token_under_every_order(spark):
    rng = np.random.default_rng(4)
    pool = rng.integers(-2**62, 2**62, 400).tolist()
    df = {t: int(d) for t, d in zip(pool, rng.integers(2, 60, 400))}
    sets = {}
    for i in range(0, 60, 2):
        s = rng.choice(pool, 90, replace=False).tolist()
        sets[i], sets[i + 1] = s, s[:82] + rng.choice([t for t in pool if t not in s], 6, replace=False).tolist()
    nodes = spark.createDataFrame([(i, i, len(s) + 3, s, [df[t] for t in s]) for i, s in sets.items()], "id long, component long, n long, tokens array<long>, df array<long>")
    found = {}
    for r in nj.prefixes(nodes, 80).collect():
        found.setdefault((r["ord"], r["id"]), {})[r["token"]] = r["pos"]
    for k in range(nj.ORDERS):
        for i in sets:
            length = len(sets[i]) + 3 - -(-80 * (len(sets[i]) + 3) // 100) + 1
            assert sorted(found[k, i].values()) == list(range(3, length))
        for i, j in ((i, j) for i in sets for j in sets if i < j):
            both = len(set(sets[i]) & set(sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) + 6 - both):
                assert found[k, i].keys() & found[k, j].keys()
    assert len({tuple(sorted(found[k, 0])) for k in range(nj.ORDERS)}) == nj.ORDERS


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op12_ngram_join"](spark, folder)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute.near(texts, 5)
