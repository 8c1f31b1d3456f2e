"""Stages of the pipeline decide on rows: repeated and null ids, null texts, extra columns, empty tables."""

import random

import pytest

import corpus_pipeline as cp
from tests.llm import data

STAGE = dict(cp.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("labels")
    data.labels(spark, [(1, 1, 0), (None, 0, 0)]).write.parquet(f"{where}/labels.parquet")
    return str(where)


def _rows(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())


def test_each_row_has_its_own_verdict(spark, folder):
    rng = random.Random(1)
    a, b, c, near = (data.prose(rng, 120) for _ in range(4))
    rows = [(1, a, "x"), (1, b, "x"), (0, b, "y"), (None, c, "x"), (None, c, "x"), (None, a, "z"), (7, "too short", "x"), (7, near, "x"), (8, near + " more", "y"), (9, None, "x"), (1, a, "x")]
    docs = data.table(spark, rows)
    kept = STAGE["quality_rules"](spark, docs, folder)
    assert kept.columns == docs.columns
    assert _rows(kept) == sorted((k is None, k or 0, t) for k, t, _ in rows if t and len(t.split()) >= 50)
    first = STAGE["exact_dedup"](spark, kept, folder)
    assert _rows(first) == sorted([(False, 0, b), (False, 1, a), (True, 0, c), (False, 7, near), (False, 8, near + " more")])
    one = STAGE["near_dedup"](spark, first, folder)
    assert _rows(one) == sorted([(False, 0, b), (False, 1, a), (True, 0, c), (False, 7, near)])
    mixed = STAGE["mix_sources"](spark, one, folder)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {0, 1, 7, None}
    assert STAGE["byte_bpe"](spark, mixed, folder).count() == mixed.count()


def test_empty_table(spark, folder):
    docs = data.table(spark, [])
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0 and "n_chars" in docs.columns, name
    assert STAGE["byte_bpe"](spark, docs, folder).count() == 0


def test_ids_sort_as_numbers(spark):
    ids = [-(2**63), -5, -1, 0, 3, 10, 2**63 - 1, None]
    rows, row = cp._known(spark.createDataFrame([(i, "t", "x") for i in ids], "doc_id long, text string, _row string"))
    got = rows.orderBy(row).collect()
    assert row == "_row_" and [r["doc_id"] for r in got] == ids
