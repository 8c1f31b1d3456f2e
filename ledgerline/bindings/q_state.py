"""Bindings of sources, sheets, state operators and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.bindings import duck as D
from ledgerline.bindings.q_keys import URL_PATH, url_path
from ledgerline.bindings.registry import DERIVED, query
from ledgerline.functions import fixed, keys as K
from ledgerline.functions.text import epoch_s
from ledgerline.operators import rollups as R, sheets as H, state as S
from ledgerline.session import shared_folder
from ledgerline.sources import readers, sinks
from ledgerline.streaming import streams

NOW = 1706745600


def _scratch(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/ledgerline/{name}-{uuid.uuid4().hex}"


# --- sources --------------------------------------------------------------------------------
@query("src_scan_listing", f"""
SELECT page_id, {D.ext(URL_PATH)} AS ext FROM pages WHERE {D.ext(URL_PATH)} IN ('html', 'htm')""")
def src_scan_listing(t):
    rows = t.pages.select("page_id", K.file_ext(url_path()).alias("ext"))
    return rows.filter(F.col("ext").isin("html", "htm"))


def _nested(t):
    """Album records as a catalogue service would return them, from flat tables."""
    tracks = t.tracks.groupBy("album_id").agg(F.collect_list(F.struct(
        "track_id", "title", "has_file", F.when(F.col("track_monitored"), F.lit(None).cast("boolean")).otherwise(False).alias("monitored"))).alias("tracks"))
    rel = t.releases.groupBy("album_id").agg(F.array_sort(F.collect_list(F.struct("release_id", "track_count", "monitored"))).alias("releases"))
    return (t.albums.join(tracks, "album_id", "left").join(rel, "album_id", "left").select(
        F.col("album_id").alias("id"), F.col("release_date").alias("title"), F.when(F.col("monitored"), True).alias("monitored"),
        F.struct(F.col("artist_id").alias("id")).alias("artist"), F.struct(F.nullif("have", F.lit(0)).alias("have"), "total").alias("statistics"), "releases", "tracks"))


@query("src_catalogue_snapshot", """
SELECT a.album_id, a.artist_id, a.monitored, a.have, a.total, COALESCE(r.n, 0) AS n_releases, COALESCE(t.n, 0) AS n_tracks, COALESCE(t.m, 0) AS n_monitored FROM albums a
LEFT JOIN (SELECT album_id, COUNT(*) AS n FROM releases GROUP BY 1) r ON a.album_id = r.album_id
LEFT JOIN (SELECT album_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE track_monitored) AS m FROM tracks GROUP BY 1) t ON a.album_id = t.album_id""")
def src_catalogue_snapshot(t):
    albums, releases, tracks = readers.src_catalogue_snapshot(_nested(t))
    r = releases.groupBy("album_id").agg(F.count("*").alias("n_releases"))
    k = tracks.groupBy("album_id").agg(F.count("*").alias("n_tracks"), F.count_if("monitored").alias("n_monitored"))
    return albums.drop("title").join(r, "album_id", "left").join(k, "album_id", "left").na.fill(0, ["n_releases", "n_tracks", "n_monitored"])


def _pages(t):
    # pages of 1000 records that overlap by 10, as a list that shifts while read
    o = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.floor(F.col("o_orderkey") / 990).alias("p"), (F.col("o_orderkey") % 990).alias("m"))
    copies = o.withColumn("page", F.explode(F.when((F.col("m") < 10) & (F.col("p") > 0), F.array(F.col("p"), F.col("p") - 1)).otherwise(F.array("p"))))
    total = t.orders.agg(F.count("*")).scalar()
    return copies.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "price"))).alias("records")).withColumn("total_records", total)


@query("src_paged_dump", "SELECT o_orderkey, o_totalprice AS price, (SELECT COUNT(*) FROM orders) AS received, true AS complete FROM orders")
def src_paged_dump(t):
    rows, check = readers.src_paged_dump(_pages(t), id_field="o_orderkey")
    return rows.withColumn("received", check.select("received").scalar()).withColumn("complete", check.select("complete").scalar())


_LATIN, _CYRILLIC = readers._high("cp1251")
_NARROW = "regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g')"


@query("src_sheet_corpus", f"""
WITH d AS (SELECT doc_id, text, {_NARROW} AS narrow, regexp_matches(text, '[^\\x{{00}}-\\x{{7F}}]') AS high FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN text WHEN doc_id % 4 = 3 THEN narrow || '˜' WHEN high THEN translate(narrow, '{_LATIN}', '{_CYRILLIC}') ELSE narrow END AS text,
 CASE WHEN doc_id % 4 < 2 THEN 'utf-8-sig' WHEN doc_id % 4 = 3 THEN 'cp1252' WHEN regexp_matches(narrow, '[^\\x{{00}}-\\x{{7F}}]') THEN 'cp1251' ELSE 'utf-8-sig' END AS encoding FROM d""")
def src_sheet_corpus(t):
    """Documents as bytes: with and without a byte order mark, and in one byte a character, with and without one that no Cyrillic encoding has."""
    raw, narrow, i = F.encode("text", "UTF-8"), F.encode("text", "ISO-8859-1"), F.col("doc_id") % 4
    content = F.when(i == 0, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(i == 1, raw).when(i == 2, narrow).otherwise(F.concat(narrow, F.unhex(F.lit("98"))))
    return readers.decode_sheets(t.documents.select("doc_id", content.alias("content")))


@query("sink_report", "SELECT CAST(l_returnflag AS STRING) AS flag, COUNT(*) AS n FROM lineitem GROUP BY 1")
def sink_report(t):
    out = t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    folder = _scratch(t, "report")
    sinks.sink_report(out, folder, "csv", single_file=True)
    return t.spark.read.option("header", True).schema("flag string, n long").csv(folder)


@query("sink_snapshot_swap", "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer")
def sink_snapshot_swap(t):
    folder = _scratch(t, "snapshot")
    c = t.customer.select("c_custkey", "c_acctbal")
    sinks.sink_snapshot_swap(c, folder)
    sinks.sink_snapshot_swap(sinks.read_snapshot(t.spark, folder).withColumn("c_acctbal", F.col("c_acctbal") + 1), folder)
    return sinks.read_snapshot(t.spark, folder)


# --- sheets -----------------------------------------------------------------------------------
def sheets_from_lines(t):
    """One sheet per order, one track per line item."""
    num = lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    k, n, p, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    body = F.concat(
        F.lit("  TRACK "), num(n), F.lit(" AUDIO\r\n    TITLE \"Song "), p.cast("string"), F.lit("\"\r\n"),
        F.when(n % 2 == 0, F.concat(F.lit("    performer \"Act "), (s % 3).cast("string"), F.lit("\"\n"))).otherwise(""),
        F.lit("    INDEX 00 00:00:00\n    INDEX 01 "), num(n * 5), F.lit(":"), num(p % 60), F.lit(":"), num(s % 75), F.lit("\n"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), p.alias("p"), s.alias("s"), body.alias("b")))).alias("r"))
    head = F.concat(
        F.lit("REM DATE 1999\nREM GENRE \"Blues\"\n"), F.when(k % 4 == 0, F.concat(F.lit("PERFORMER \"Artist "), k.cast("string"), F.lit("\"\n"))).otherwise(""),
        F.when(k % 5 != 0, F.concat(F.lit("TITLE \"Album "), k.cast("string"), F.lit("\"\n\n"))).otherwise(""), F.lit("FILE \"image.flac\" WAVE\n"))
    return rows.select(k.alias("sheet_id"), F.concat(head, F.array_join(F.transform("r", lambda x: x["b"]), "")).alias("text"),
                       F.concat(F.lit("[tag] Folder Act - Folder "), k.cast("string"), F.lit(" (1990)")).alias("folder"), F.lit(9000.0).alias("duration_s"))


DERIVED["sheet_tracks"] = """
SELECT l_orderkey AS sheet_id, l_linenumber AS number, 'Song ' || l_partkey AS title, CASE WHEN l_linenumber % 2 = 0 THEN 'Act ' || (l_suppkey % 3) ELSE '' END AS performer,
 l_linenumber * 300 + l_partkey % 60 + (l_suppkey % 75) / 75.0 AS start_s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem
"""


@query("job_parse_sheets", """
SELECT sheet_id, number, title, performer, round(start_s, 4) AS start_s, round(COALESCE(lead(start_s) OVER (PARTITION BY sheet_id ORDER BY pos), 9000.0), 4) AS end_s FROM sheet_tracks""")
def job_parse_sheets(t):
    _, tracks = H.job_parse_sheets(sheets_from_lines(t))
    return tracks.select("sheet_id", "number", "title", "performer", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"))


@query("job_parse_sheet_heads", """
WITH v AS (SELECT sheet_id, performer, COUNT(*) AS n, MIN(pos) AS f FROM sheet_tracks WHERE performer <> '' GROUP BY 1, 2), b AS (SELECT sheet_id, performer FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY n DESC, f) AS rn FROM v) WHERE rn = 1)
SELECT k.sheet_id, CASE WHEN k.sheet_id % 5 <> 0 THEN 'Album ' || k.sheet_id ELSE 'Folder ' || k.sheet_id END AS title, CASE WHEN k.sheet_id % 4 = 0 THEN 'Artist ' || k.sheet_id WHEN b.performer IS NOT NULL THEN b.performer ELSE 'Folder Act' END AS performer,
 '1999' AS date, 'Blues' AS genre, 1 AS n_files FROM (SELECT DISTINCT sheet_id FROM sheet_tracks) k LEFT JOIN b ON k.sheet_id = b.sheet_id""")
def job_parse_sheet_heads(t):
    heads, _ = H.job_parse_sheets(sheets_from_lines(t))
    return heads.select("sheet_id", "title", "performer", "date", "genre", "n_files")


@query("job_fold_lines", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents)
SELECT doc_id, COUNT(*) AS n_lines FROM l WHERE trim(line) <> '' GROUP BY doc_id""")
def job_fold_lines(t):
    return H.sheet_lines(t.documents, sheet="doc_id").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


# --- state, batch form ------------------------------------------------------------------------------
DERIVED["ev"] = "SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events"


def _ev(t):
    return t.events.select("event_id", "user_id", "event_type", "value", epoch_s("ts").alias("s"))


@query("st_change_gate", """
WITH c AS (SELECT user_id AS key, COUNT(*) || ':' || CAST(MAX(s) AS BIGINT) AS signature FROM ev GROUP BY 1), l AS (SELECT user_id AS key, COUNT(*) || ':' || CAST(MAX(s) AS BIGINT) AS signature FROM ev WHERE s < 1706572800 GROUP BY 1)
SELECT key, signature FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.key = c.key AND l.signature = c.signature)""")
def st_change_gate(t):
    sig = lambda df: df.groupBy(F.col("user_id").alias("key")).agg(F.concat_ws(":", F.count("*").cast("string"), F.max("s").cast("string")).alias("signature"))
    return S.st_change_gate(sig(_ev(t)), sig(_ev(t).filter("s < 1706572800")))


@query("st_ttl_ledger", f"""
WITH c AS (SELECT user_id AS key, CAST(COUNT(*) % 5 AS STRING) AS signature FROM ev GROUP BY 1), l AS (SELECT user_id AS key, CAST(COUNT(*) % 5 AS STRING) AS signature, MAX(s) AS ts, COUNT(*) % 4 AS attempts FROM ev WHERE event_type <> 'view' AND user_id % 9 <> 0 AND s < 1706650000 GROUP BY 1),
w AS (SELECT c.key, c.signature, CASE WHEN l.ts IS NULL THEN 'new' WHEN l.signature <> c.signature THEN 'changed' WHEN {NOW} - l.ts >= 100000 AND l.attempts < 3 THEN 'expired' END AS why FROM c LEFT JOIN l ON c.key = l.key)
SELECT * FROM w WHERE why IS NOT NULL""")
def st_ttl_ledger(t):
    e = _ev(t)
    sig = (F.count("*") % 5).cast("string").alias("signature")
    cur = e.groupBy(F.col("user_id").alias("key")).agg(sig)
    led = e.filter("event_type <> 'view' AND user_id % 9 <> 0 AND s < 1706650000").groupBy(F.col("user_id").alias("key")).agg(sig, F.max("s").alias("ts"), (F.count("*") % 4).alias("attempts"))
    return S.st_ttl_ledger(cur, led, now=NOW, ttl_s=100000, max_attempts=3)


@query("st_recheck_gap", """
SELECT user_id, s, event_id FROM (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS p FROM ev) WHERE p IS NULL OR s - p >= 21600""")
def st_recheck_gap(t):
    return S.st_recheck_gap(_ev(t), key="user_id", ts="s", gap_s=21600, ordinal="event_id").select("user_id", "s", "event_id")


def _sightings(t):
    return _ev(t).select(F.col("user_id").alias("key"), F.col("s").alias("ts"), "event_id",
                         F.floor(F.col("s") / 400000).cast("string").alias("signature"), (F.col("value") > 150).alias("done"))


_THROTTLE = """
WITH RECURSIVE a AS (SELECT user_id AS key, s AS ts, event_id, CAST(CAST(floor(s / 400000) AS BIGINT) AS STRING) AS signature, value > 150 AS done, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS rn FROM ev),
f AS (SELECT key, rn, ts, event_id, signature, done AS fin, CASE WHEN done THEN NULL ELSE ts END AS planned, NOT done AS hit FROM a WHERE rn = 1
 UNION ALL SELECT a.key, a.rn, a.ts, a.event_id, a.signature, f.fin OR a.done, CASE WHEN NOT (f.fin OR a.done) AND (f.planned IS NULL OR a.signature <> f.signature OR a.ts - f.planned >= 43200) THEN a.ts ELSE f.planned END,
  NOT (f.fin OR a.done) AND (f.planned IS NULL OR a.signature <> f.signature OR a.ts - f.planned >= 43200) FROM f JOIN a ON a.key = f.key AND a.rn = f.rn + 1)
SELECT key, ts, event_id, signature FROM f WHERE hit"""


@query("st_recheck_throttle", _THROTTLE)
def st_recheck_throttle(t):
    return S.st_recheck_throttle(_sightings(t), key="key", ts="ts", signature="signature", done="done", recheck_s=43200, ordinal="event_id").select("key", "ts", "event_id", "signature")


@query("st_upsert_held", """
WITH u AS (SELECT 'path/' || user_id AS source_path, s AS ts, event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS artist, CASE WHEN event_id % 4 = 0 THEN repeat('r' || event_id, 200) ELSE '' END AS reason FROM ev)
SELECT source_path, substr(sha1(source_path), 1, 12) AS id, COALESCE(arg_max(artist, ts) FILTER (WHERE artist <> ''), '') AS artist, COALESCE(substr(arg_max(reason, ts) FILTER (WHERE reason <> ''), 1, 500), '') AS reason,
 MIN(ts) AS created, MAX(ts) AS updated, COUNT(*) AS seen_count FROM u GROUP BY 1""")
def st_upsert_held(t):
    return S.st_upsert_held(_held_updates(t), fields=("artist", "reason"))


def _held_updates(t):
    i = F.col("event_id")
    return _ev(t).select(F.concat(F.lit("path/"), F.col("user_id").cast("string")).alias("source_path"), F.col("s").alias("ts"), i.alias("ordinal"),
                         F.when(i % 3 == 0, "").otherwise(F.col("event_type")).alias("artist"),
                         F.when(i % 4 == 0, F.repeat(F.concat(F.lit("r"), i.cast("string")), 200)).otherwise("").alias("reason"))


@query("st_upsert_plan", """
WITH o AS (SELECT user_id AS id, MIN(s) AS created, COUNT(*) AS n FROM ev WHERE s < 1705000000 GROUP BY 1), n AS (SELECT user_id AS id, MAX(s) AS created, 1000 + COUNT(*) AS n FROM ev WHERE s >= 1705000000 AND user_id % 4 <> 0 GROUP BY 1)
SELECT COALESCE(o.id, n.id) AS id, COALESCE(o.created, n.created) AS created, COALESCE(n.n, o.n) AS n FROM o FULL JOIN n ON o.id = n.id""")
def st_upsert_plan(t):
    e = _ev(t)
    old = e.filter("s < 1705000000").groupBy(F.col("user_id").alias("id")).agg(F.min("s").alias("created"), F.count("*").alias("n"))
    new = e.filter("s >= 1705000000 AND user_id % 4 <> 0").groupBy(F.col("user_id").alias("id")).agg(F.max("s").alias("created"), (F.count("*") + 1000).alias("n"))
    return S.st_upsert_plan(old, new)


@query("st_first_missing", f"""
WITH f AS (SELECT user_id, MAX(CASE WHEN event_type = 'purchase' THEN s END) AS filled FROM ev GROUP BY 1)
SELECT e.user_id, MIN(s) AS missing_since, {NOW} - MIN(s) >= 3 * 86400 AS eligible FROM ev e JOIN f ON e.user_id = f.user_id WHERE event_type <> 'purchase' AND (filled IS NULL OR s > filled) GROUP BY 1""")
def st_first_missing(t):
    return S.st_first_missing(_ev(t).withColumn("missing", F.col("event_type") != "purchase"), key="user_id", ts="s", missing="missing", now=NOW, min_days=3)


@query("st_complete_once", "SELECT user_id, MIN(s) AS s FROM ev WHERE value > 200 GROUP BY user_id")
def st_complete_once(t):
    return S.st_complete_once(_ev(t).withColumn("full", F.col("value") > 200), key="user_id", ts="s", complete="full")


@query("st_dead_timer", f"SELECT user_id, MIN(s) AS added, MAX(value / 40000) AS best FROM ev GROUP BY 1 HAVING MAX(value / 40000) < 0.01 AND {NOW} - MIN(s) >= 172800")
def st_dead_timer(t):
    return S.st_dead_timer(_ev(t).withColumn("p", F.col("value") / 40000), key="user_id", ts="s", progress="p", now=NOW, grace_s=172800)


_IDLE = f"""SELECT user_id, idle_from, idle_to FROM (SELECT user_id, s AS idle_from, COALESCE(lead(s) OVER (PARTITION BY user_id ORDER BY s), {NOW}) AS idle_to FROM ev) WHERE idle_to - idle_from >= 86400"""


@query("st_idle_timer", _IDLE)
def st_idle_timer(t):
    return S.st_idle_timer(_ev(t), key="user_id", ts="s", now=NOW, grace_s=86400)


@query("st_detail_cache", """
SELECT event_id, event_id % 10 NOT IN (1, 2) AS cached FROM ev WHERE event_id % 10 <> 3""")
def st_detail_cache(t):
    e = _ev(t).select(F.col("event_id").alias("path"), F.col("s").alias("mtime"), F.col("value").alias("size"))
    cache = e.filter("path % 10 <> 1").withColumn("mtime", F.when(F.col("path") % 10 == 2, F.col("mtime") - 1).otherwise(F.col("mtime")))
    kept, stale = S.st_detail_cache(e.filter("path % 10 <> 3"), cache)
    return kept.select(F.col("path").alias("event_id"), F.lit(True).alias("cached")).unionByName(stale.select(F.col("path").alias("event_id"), F.lit(False).alias("cached")))


@query("st_queue_restore", "SELECT job_id, 'queued' AS state, CAST(0 AS DOUBLE) AS pct FROM jobs WHERE state IN ('queued', 'running')")
def st_queue_restore(t):
    return S.st_queue_restore(t.jobs).select("job_id", "state", "pct")


@query("st_clear_failed_queue", "SELECT job_id, state FROM jobs WHERE state = 'failed'")
def st_clear_failed_queue(t):
    return S.st_clear_failed_queue(t.jobs).select("job_id", "state")


# --- state, streaming form: the same SQL checks the drained stream ----------------------------------------
def _stream_ev(t):
    e = streams.stream_table(t.spark, t.folder, "events")
    return e.select("event_id", "user_id", "event_type", "value", "ts", epoch_s("ts").alias("s"))


def _drain(t, stream, name):
    out, mark = _scratch(t, name), _scratch(t, name + "-checkpoint")
    schema = stream.schema
    streams.run_to_table(stream, out, mark)
    return t.spark.read.schema(schema).parquet(out)
