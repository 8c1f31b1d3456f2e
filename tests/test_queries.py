"""A cross-section of the registered queries against their SQL twins.

``python tests/oracle.py 0.01`` runs all of them.
"""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from ledgerline import bindings
from tests import oracle

FOLDER = "/root/testdata/sf0.01"
NAMES = [
    "key_song_title", "key_script_artist", "key_credit_sets", "key_search_variants", "flt_wanted", "flt_answer_guard", "sim_identity_f1",
    "join_duration_tolerance", "join_four_gates", "join_token_block", "join_word_subset", "join_album_owned", "join_ancestor", "join_external_gap",
    "agg_plan_album", "agg_dir_rollup", "agg_coverage_rank", "win_one_per_track", "win_budget", "win_cheap_first", "set_drop_merge", "dec_lifecycle",
    "dec_download_class", "job_parse_sheets", "src_paged_dump", "st_recheck_throttle", "st_throttle_stream", "st_upsert_stream", "sink_snapshot_swap",
    "sim_title", "flt_facet_counts", "src_sheet_corpus", "src_new_file_stream", "st_dead_timer_stream", "plan_harvest",
]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    took, n, ok, note = oracle.compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note
    assert n > 0


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).columns == ["ordinal", "want_ordinal", "delta_ms", "outcome"]


@pytest.mark.parametrize("name", ["join_four_gates", "join_resolve_artist", "join_album_disambiguate", "join_ancestor", "join_word_subset",
                                  "agg_plan_album", "flt_excluded_prefix", "dec_lifecycle", "win_budget"])
def test_no_products(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pruned(spark):
    plan = entry.queries()["agg_wanted_missing"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "l_comment" not in plan and "l_extendedprice" not in plan


def test_titles_scored_by_ratio(spark, con):
    """All title pairs next to difflib, those that neither equality nor containment settles too."""
    from difflib import SequenceMatcher

    got = {r["id"]: r["score"] for r in entry.queries()["sim_title"](spark, FOLDER).collect()}
    pairs = con.execute("SELECT p_partkey, p_name, p_type FROM part").fetchall()
    assert set(got) == {i for i, _, _ in pairs}
    for i, a, b in pairs:
        if i % 5 == 4 and a not in b and b not in a:
            assert abs(got[i] - SequenceMatcher(None, a, b).ratio()) < 1e-6, (a, b)


def test_later_lines_are_sources(spark, tmp_path):
    lines = "Some other heading\nGloomy Sunday Evening\nSugar and Spice"
    spark.createDataFrame([(1, lines)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Sugar and Spice"), (2, "Gloomy Sunday Evenings")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["want"], r["cand"], r["kind"]) for r in entry.queries()["join_title_close_lines"](spark, str(tmp_path)).collect()}
    assert {k for _, _, k in got} == {"exact", "close"}, got


def test_the_cascade_takes_every_step(spark, con):
    got = entry.queries()["join_resolve_artist"](spark, FOLDER).collect()
    assert {r["stage"] for r in got} == {"exact", "script key", "stage prefix", "substring", "fuzzy", "alias", "none"}
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(f"SELECT name, artist_id, stage FROM ({entry.oracle_sql()['join_resolve_artist']})").fetchall(), key=str)


def test_a_live_song_is_not_the_studio_one(spark, con):
    """Folders lose songs whose variant differs: the query's own tables hold both kinds."""
    lost = con.execute("SELECT count(*) FROM (" + entry.oracle_sql()["join_album_by_songs"].split("nf AS (")[0].rstrip().rstrip(",") + """
        SELECT f.song FROM f WHERE NOT EXISTS (SELECT 1 FROM a WHERE f.song = a.song AND f.v = a.v))""").fetchone()[0]
    assert lost > 100
    took, n, ok, note = oracle.compare(spark, con, FOLDER, "join_album_by_songs", entry.queries()["join_album_by_songs"], entry.oracle_sql()["join_album_by_songs"])
    assert ok and n > 0, note


def test_the_rest_imports_without_the_optional_modules(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "ledgerline", tmp_path / "ledgerline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "corpus_pipeline.py").write_text("import ledgerline.llm\n")
    code = "import __spark_entry__ as e, ledgerline; print(ledgerline.__file__); print(*e.queries())"
    told = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.splitlines()
    assert told[0].startswith(str(tmp_path))
    assert set(told[1].split()) == set(bindings.queries())


def test_volume_numbers_are_no_years(spark, tmp_path):
    rows = [(n, f"Supplier#{n:09d}", 1, 0.0) for n in (7, 1899, 1950, 2020, 2099, 2100)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["s_suppkey"], r["term"], r["pos"]) for r in entry.queries()["tvf_search_variants"](spark, str(tmp_path)).collect()}
    assert got == {(n, f"{name} Volume {n}{tail}", pos) for n, name, _, _ in rows for pos, tail in enumerate((" Blues", ""))}
