"""Operators with Python in their tasks, each against a plain form, and the pipeline."""

import base64
import hashlib
import pickle
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerline.llm import bpe, near_dedup, pii, quality_model, suffix_dedup, toxicity
from ledgerline.llm.components import components
from tests.llm import brute, data

ODD = data.odd_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return data.table(spark, ODD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return data.table(spark, [])


def test_plain_identifiers():
    rng = random.Random(3)
    for chars in ("ab@@..%-_+ 0159 1()é\n", "0123456789 -", "+1 ().-5"):
        for _ in range(5_000):
            text = "".join(rng.choice(chars) for _ in range(rng.randrange(0, 40)))
            assert pii.plain(text) == brute.plain_pii(text), text


@pytest.mark.parametrize("text, kind, hidden", [
    ("mail john dot doe at example dot com now", "email", "john dot doe at example dot com"),
    ("x john [at] example (dot) com y", "email", "john [at] example (dot) com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
    ("é ４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("ip one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ("192.168.1.​20 a", "ip", "192.168.1.​20"),
    ("or jane [@] example [.] com", "email", "jane [@] example [.] com"),
    ("host 192[.]168[.]1[.]20", "ip", "192[.]168[.]1[.]20"),
    ("call +1 5five5 123 4567", "phone", "+1 5five5 123 4567"),
    ("u=jane%40example.com&x", "email", "jane%40example.com"),
    ("card 4l11 1111 1111 1111", "card", "4l11 1111 1111 1111"),
    ("contact jane at example.com", "email", "jane at example.com"),
])
def test_disguises_keep_offsets(text, kind, hidden):
    assert (kind, hidden) in [(k, text[a:b]) for k, a, b, base in pii.found(text) if not base]


@pytest.mark.parametrize("text", ["look at the dot on the page", "one two three at noon", "meet me at seven", "a (dot) b", "Élève à l'école 5 ½", ""])
def test_clean_texts_have_none(text):
    assert pii.found(text) == []


@pytest.mark.parametrize("text, kind, hidden", [
    ("pay 4111 1111 1111 111 one now", "card", "4111 1111 1111 111 one"),
    ("call +1 five 5 five 1 two 3 four 5 six 7", "phone", "+1 five 5 five 1 two 3 four 5 six 7"),
    ("mail john at example dot dk", "email", "john at example dot dk"),
    ("mail john at example.com", "email", "john at example.com"),
    ("mail john at mail.example.co.nz.", "email", "john at mail.example.co.nz"),
])
def test_mixed_digits_and_other_endings(text, kind, hidden):
    assert (kind, hidden) in [(k, text[a:b]) for k, a, b, base in pii.found(text) if not base]


@pytest.mark.parametrize("text", ["look at example.com for more", "we met at noon. It rained", "he sat at home.It was late", "stare at the dot is fun", "at 5 p.m. sharp", "sold at version 2.0",
                                  "shop at amazon.com for more", "He works at google.com today", "Come at www.site.org now", "Sign up at example.org", "email me at example.com"])
def test_prose_with_at_has_none(text):
    assert pii.found(text) == []


@pytest.mark.parametrize("text", ["(at) x" + " " * 10**6, "one one" + " " * 10**6, " " * 10**6 + "(at)", "one" + "\n" * 10**6 + "dot", "1 " * 500_000, "a at " + "b." * 500_000, "+1" + " " * 10**6])
def test_time_is_linear(text):
    import time

    start = time.process_time()
    pii.found(text)
    assert time.process_time() - start < 6  # the quadratic forms took an hour


def test_spelled_pretest_is_necessary():
    rng = random.Random(15)
    parts = ["one", "Two", "oh", "5", "plus", " ", "-", " dot ", "\n", "x", "sıx"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(8))
        if any(pii._digits(m, 0) for m in pii._SPELLED.finditer(text)):
            assert pii.normalised(text) is not None, text


def test_pii_rows(docs, empty):
    got = pii.detected(docs).collect()
    assert len(got) == len(ODD) and all(r["spans"] == [] for r in got if r["key"] in (1, 2, 3))
    assert pii.detected(empty).count() == 0


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_is_exact(ranks):
    rng = random.Random(1)
    texts = ["", " ", "   \n\n  x", "abc" * 500, "日本語👍🏽" * 50, "ab" * 3000, " " * 700, "".join(rng.choice("abcde") for _ in range(4000)),
             "<|endoftext|>'ll it's", "".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(2000)), *(t for _, t, _ in ODD if t)]
    vocabulary = bpe._vocabulary(ranks)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())})
    ids, size = bpe.encode_texts(texts, vocabulary, bpe._pattern(public_tokenizers.PATTERN))
    for text, part in zip(texts, np.split(ids, np.cumsum(size)[:-1])):
        assert part.tolist() == own.encode_ordinary(text)
        assert vocabulary.decode(part)[0].tobytes().decode() == text


def test_bpe_round_trip(docs, empty, ranks):
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, out="ids"), ranks)
    assert sorted(map(str, ((r["doc_id"], bytes(r["decoded"]).decode()) for r in coded.collect()))) == sorted(map(str, ((k, t or "") for k, t, _ in ODD)))
    assert bpe.encode(empty, ranks, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n", [4, 5])
def test_near_groups(docs, empty, n):
    got = {r["key"]: (r["n_shingles"], r["component"]) for r in near_dedup.near_groups(docs, words=n).collect() if r["key"] is not None}
    want = brute.near({k: t for k, t, _ in ODD if k is not None}, n)
    assert got == want
    if n == 5:
        assert near_dedup.near_groups(empty).count() == 0


def test_near_chain_and_large_group(spark, monkeypatch):
    """Links that the least of a bucket does not see, in buckets larger than a stripe."""
    monkeypatch.setattr(near_dedup, "STRIPE", 4)
    rng = random.Random(6)
    base = data.prose(rng, 120).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(len(w)), rng.randint(0, 9)):
            w[k] = f"w{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w), "a"))
    got = {r["key"]: (r["n_shingles"], r["component"]) for r in near_dedup.near_groups(data.table(spark, rows), words=4).collect()}
    assert got == brute.near({k: t for k, t, _ in rows}, 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5), (200, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(31), 200]} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_run_index(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LEAST", 4)
    rng = random.Random(5)
    for _ in range(200):
        parts = [bytes(rng.choice(b"aab") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))]
        index = suffix_dedup.RunIndex(parts)
        text = index.text.tolist()
        assert index.order.tolist() == sorted(range(index.n), key=lambda i: text[i:])
        often = [p[i:i + 4] for p in parts for i in range(len(p) - 3)]
        assert [x.tolist() for x in index.repeated()] == [[i for i in range(len(p) - 3) if often.count(p[i:i + 4]) > 1] for p in parts]


def test_segments_cover_every_window():
    rng = random.Random(7)
    for n in (399, 400, 401, 3000):
        text = bytes(rng.choice(b"ab") for _ in range(n))
        runs = list(suffix_dedup.segments(text))
        assert [a + i for a, w, _, _ in runs for i in range(w)] == list(range(max(0, n - 399)))


@pytest.mark.parametrize("together", [1, 2_000])
def test_repeats(spark, docs, empty, monkeypatch, together):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    rng = random.Random(11)
    passage, other = data.prose(rng, 130), data.prose(rng, 70)
    texts = [data.prose(rng, 60) + " " + passage + " " + data.prose(rng, 20) for _ in range(4)]
    texts += [other * 3, "x" * 1500, "é" * 700, passage[:399], passage[50:480], "", None, data.prose(rng, 300), texts[0], texts[0]]
    got = {r["key"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in suffix_dedup.without_repeats(data.table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    want = brute.without_repeats([(t or "").encode() for t in texts], 400)
    assert got == dict(enumerate(want))
    if together > 1:
        assert suffix_dedup.without_repeats(docs).count() == len(ODD)
        assert suffix_dedup.without_repeats(empty).count() == 0


def _auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    y = np.array(labels)
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality_model(spark, docs, empty):
    rng = random.Random(12)
    rows = [(i, data.prose(rng, 80) if i % 3 else data.prose(rng, 80).replace(" ", " # "), "s") for i in range(300)]
    labels = data.labels(spark, [(i, int(i % 3 > 0), 0) for i in range(300)])
    got = {r["key"]: r["score"] for r in quality_model.scored(data.table(spark, rows), labels).collect()}
    assert _auc([got[i] for i in range(300)], [int(i % 3 > 0) for i in range(300)]) > 0.99
    odd = quality_model.scored(docs, data.labels(spark, [])).collect()
    assert len(odd) == len(ODD) and {r["score"] for r in odd} == {0.5}
    assert quality_model.scored(empty, labels).count() == 0


def test_model_finds_interactions():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality_model.fit(x[:3000], y[:3000], np.arange(3000) % 5 == 0, ["a", "b", "c"])
    assert _auc(model.scores(x[3000:]), y[3000:]) > 0.95


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    rows = rng.random((400, 30)) * (rng.random((400, 30)) < 0.2)
    rows = toxicity.dense([np.flatnonzero(r) for r in rows], [np.ones(int((r > 0).sum())) + 1 for r in rows], np.arange(1.0, 31.0))
    index = toxicity.Index.of(np.arange(300), np.arange(300) % 2, np.ones(300), rows[:300])
    who, cosine = index.nearest(rows[300:])
    full = np.sort(rows[300:] @ rows[:300].T, axis=1)[:, ::-1][:, :toxicity.NEIGHBOURS]
    assert np.allclose(cosine, full, atol=1e-5)
    own, _ = index.nearest(rows[:300], np.arange(300))
    assert not (own == np.arange(300)[:, None]).any()


def test_nearest_is_exact_with_rare_terms():
    """Common terms in the table, rare ones as postings, several blocks, equal rows and a row without terms."""
    rng = np.random.default_rng(3)
    ids = [np.unique(np.minimum(rng.zipf(1.2, 60), 3000) - 1) for _ in range(700)]
    ids[5], ids[600] = np.empty(0, int), ids[7]
    rows, square = toxicity.weighted(ids, [rng.integers(1, 4, len(i)) if k not in (7, 600) else np.ones(len(i)) for k, i in enumerate(ids)], 1 + rng.random(3000))
    full = np.zeros((700, 3000))
    full[rows.of_row(), rows.ids] = rows.weights
    index = toxicity.Index.of(np.arange(500), np.arange(500) % 2, np.ones(500), rows.part(np.arange(500)), 3000)
    index = pickle.loads(pickle.dumps(index))
    assert (index.common < 0).sum() == 3000 - toxicity.COMMON and index.blocks == 8
    for at, own in ((np.arange(500, 700), None), (np.arange(500), np.arange(500))):
        who, cosine = index.nearest(rows.part(at), own)
        want = np.round(full[at] @ full[:500].T, 12)
        if own is not None:
            np.fill_diagonal(want, 0)
        order = np.lexsort((np.broadcast_to(np.arange(500), want.shape), -want), axis=1)[:, :toxicity.NEIGHBOURS]
        near = np.take_along_axis(want, order, 1)
        assert np.allclose(cosine, near, atol=1e-11) and (who == np.where(near > 0, order, -1)).mean() > 0.999


def test_toxicity_hears_one_word_in_a_long_text(spark):
    rng = random.Random(15)
    rows = [(i, data.prose(rng, 250) + (f" {rng.choice(('vileword', 'badword'))} " if i % 4 == 0 else " ") + data.prose(rng, 250), "s") for i in range(400)]
    labels = data.labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(400)])
    got = {r["key"]: r["score"] for r in toxicity.scored(data.table(spark, rows), labels).collect()}
    unseen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert _auc([got[i] for i in unseen], [int(i % 4 == 0) for i in unseen]) > 0.97


def test_toxicity(spark, docs, empty):
    rng = random.Random(13)
    rows = [(i, data.prose(rng, 60) + (" vileword badword" if i % 4 == 0 else ""), "s") for i in range(300)]
    labels = data.labels(spark, [(i, 1, int(i % 4 == 0)) for i in range(300)])
    got = {r["key"]: r for r in toxicity.scored(data.table(spark, rows), labels).collect()}
    assert all(0 <= got[i]["score"] <= 1 for i in range(300))
    assert _auc([got[i]["score"] for i in range(300)], [int(i % 4 == 0) for i in range(300)]) > 0.97
    assert got[0]["neighbours"][0]["label"] == 1
    for other in (labels, data.labels(spark, []), data.labels(spark, [(50, 1, 1), (None, 1, 0), (51, None, None)])):
        assert toxicity.scored(docs, other).count() == len(ODD)
    assert toxicity.scored(empty, labels).count() == 0


def test_toxicity_sees_every_word(spark):
    """Neighbours and cosines by brute force on all words, rare ones of examples and ones of no example too."""
    rng = random.Random(14)
    texts = {i: data.prose(rng, 30) for i in range(80)}
    texts |= {1000 + i: " ".join([*t.split()[:25], f"own{i}", "odd", "odd"]) for i, t in texts.items()}
    rows = [(i, t, "s") for i, t in texts.items()]
    labels = data.labels(spark, [(i, 1, int(i % 2)) for i in range(80)])
    got = {r["key"]: {x["key"]: x["cosine"] for x in r["neighbours"]} for r in toxicity.scored(data.table(spark, rows), labels).collect()}
    examples = [i for i in range(80) if zlib.crc32(str(i).encode()) % 4 != 2]
    want = brute.cosines(texts, examples)
    for key in texts:
        near = sorted(want[key].values(), reverse=True)[:toxicity.NEIGHBOURS]
        assert np.allclose(sorted(got[key].values(), reverse=True), [c for c in near if c > 0], atol=1e-6)
        assert all(abs(want[key][k] - c) < 1e-6 for k, c in got[key].items())
    assert all(max(got[1000 + i], key=got[1000 + i].get) == i for i in examples)


def test_pipeline(spark):
    import corpus_pipeline
    from ledgerline.llm.common import staged

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    sets = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "exact_dedup":
            texts = [" ".join(r["text"].split()) for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts)) < before
        if name == "near_dedup":
            sets = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(c == k for k, (_, c) in brute.near(sets, 5).items())
        if name == "mix_sources":
            mixed = {hashlib.sha256(r["text"].encode()).hexdigest() for r in docs.collect()}
    assert {r["decoded_sha256"] for r in docs.collect()} == mixed


def test_queries_have_the_contracts_columns(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and "pipeline" in entry.queries()
