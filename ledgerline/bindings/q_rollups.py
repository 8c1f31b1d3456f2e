"""Bindings of the aggregations and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.bindings import duck as D
from ledgerline.bindings.registry import DERIVED, query
from ledgerline.functions import fixed, keys as K, predicates as P
from ledgerline.functions.text import epoch_s
from ledgerline.operators import joins as J, rollups as R
from ledgerline.operators.common import with_keys

AUDIO = D.in_list(fixed.AUDIO_EXT_DOWNLOADS)


@query("agg_completeness", """
WITH t AS (SELECT album_id, COUNT(*) AS tt, COUNT(*) FILTER (WHERE has_file) AS th FROM tracks WHERE track_monitored GROUP BY 1),
c AS (SELECT a.album_id, have, total, COALESCE(th, 0) AS th, COALESCE(tt, 0) AS tt FROM albums a LEFT JOIN t ON a.album_id = t.album_id)
SELECT album_id, (have > 0 AND have >= total) OR (th > 0 AND th >= tt) AS complete,
 CASE WHEN have > 0 AND have >= total THEN have WHEN th > 0 AND th >= tt THEN th ELSE greatest(have, th) END AS have,
 CASE WHEN have > 0 AND have >= total THEN total WHEN th > 0 AND th >= tt THEN tt ELSE greatest(total, tt) END AS total FROM c""")
def agg_completeness(t):
    return R.agg_completeness(t.albums, t.tracks)


@query("agg_wanted_missing", "SELECT album_id, artist_id, have, total, total - have AS n_missing FROM albums WHERE monitored AND have < total")
def agg_wanted_missing(t):
    return R.agg_wanted_missing(t.albums).select("album_id", "artist_id", "have", "total", "n_missing")


@query("agg_coverage_rank", """
WITH r AS (SELECT l_suppkey AS release_key, 'Release ' || l_partkey AS title, l_partkey AS track, substr(CAST(l_shipdate AS STRING), 1, 10) AS date, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey % 10 <> 3),
f AS (SELECT release_key, title, date FROM (SELECT *, row_number() OVER (PARTITION BY release_key ORDER BY length(title), o, title, date) AS rn FROM r) WHERE rn = 1)
SELECT CAST(r.release_key AS STRING) AS release_key, COUNT(DISTINCT track) AS coverage, MIN(f.title) AS title FROM r JOIN f ON r.release_key = f.release_key GROUP BY r.release_key""")
def agg_coverage_rank(t):
    rows = t.lineitem.filter("l_linestatus = 'O'").select(
        F.col("l_suppkey").cast("string").alias("release_key"), F.concat(F.lit("Release "), F.col("l_partkey").cast("string")).alias("title"),
        F.col("l_partkey").alias("track"), F.substring(F.col("l_shipdate").cast("string"), 1, 10).alias("date"),
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.concat(F.lit("Release "), F.col("l_partkey").cast("string")).alias("t"), F.substring(F.col("l_shipdate").cast("string"), 1, 10).alias("d")).alias("ordinal"))
    own = t.supplier.filter("s_suppkey % 10 = 3").select(F.col("s_suppkey").cast("string").alias("release_key"))
    return R.agg_coverage_rank(rows, exclude=own).select("release_key", "coverage", "title")


# assembly plan: tracks of orders, sources are songs of the titles table
DERIVED["plan_tracks"] = f"""
SELECT album_id, track_id, {D.song_title('title')} AS title_key, CASE WHEN album_id % 9 = 0 THEN '' ELSE {D.credit_artist('artist')} END AS want_artist, album_id % 8 = 0 AS various, has_file FROM tracks
"""
DERIVED["plan_sources"] = f"""
SELECT id AS ordinal, 'src/' || id AS path, {D.song_title('base')} AS cand, CASE id % 3 WHEN 0 THEN '' ELSE {D.credit_artist('brand')} END AS strong FROM titles
"""
DERIVED["plan_scored"] = """
SELECT t.album_id, t.track_id, t.title_key, t.has_file, b.ordinal, b.path, b.total FROM plan_tracks t LEFT JOIN (
 SELECT k.title_key, k.want_artist, k.various, s.ordinal, s.path, p.score + CASE WHEN NOT k.various AND s.strong = k.want_artist THEN 0.05 ELSE 0.0 END AS total,
  row_number() OVER (PARTITION BY k.title_key, k.want_artist, k.various ORDER BY least(p.score + CASE WHEN NOT k.various AND s.strong = k.want_artist THEN 0.05 ELSE 0.0 END, 1.0) DESC, s.ordinal) AS rn
 FROM (SELECT DISTINCT title_key, want_artist, various FROM plan_tracks WHERE NOT has_file AND title_key <> '') k
 JOIN (SELECT w.title_key, c.cand, CASE WHEN w.title_key = c.cand THEN 1.0 ELSE 0.9 * least(length(w.title_key), length(c.cand)) / greatest(length(w.title_key), length(c.cand)) + 0.05 END AS score
   FROM (SELECT DISTINCT title_key FROM plan_tracks WHERE title_key <> '') w JOIN (SELECT DISTINCT cand FROM plan_sources) c ON contains(w.title_key, c.cand) OR contains(c.cand, w.title_key)
   WHERE w.title_key = c.cand OR w.title_key NOT IN (SELECT cand FROM plan_sources)) p ON k.title_key = p.title_key
 JOIN plan_sources s ON s.cand = p.cand
 WHERE k.various OR (k.want_artist <> '' AND (s.strong = k.want_artist OR s.strong = ''))) b
 ON NOT t.has_file AND t.title_key = b.title_key AND t.want_artist = b.want_artist AND t.various = b.various AND b.rn = 1
 WHERE t.title_key <> ''
"""


def _plan_inputs(t):
    keyed = with_keys(with_keys(t.tracks, "title", title_key=K.key_song_title), "artist", act=K.key_credit_artist)
    tracks = keyed.select(
        "album_id", "track_id", "title_key", F.when(F.col("album_id") % 9 == 0, "").otherwise(F.col("act")).alias("want_artist"),
        (F.col("album_id") % 8 == 0).alias("various"), "has_file")
    titles = with_keys(with_keys(t.titles.select("id", "base", "brand"), "base", title_key=K.key_song_title), "brand", act=K.key_credit_artist)
    strong = F.when(F.col("id") % 3 != 0, F.array("act")).otherwise(F.array().cast("array<string>"))
    sources = titles.select(
        F.col("id").alias("ordinal"), F.concat(F.lit("src/"), F.col("id").cast("string")).alias("path"),
        F.array("title_key").alias("titles"), strong.alias("strong"), F.array().cast("array<string>").alias("weak"))
    return tracks, sources


_PLAN = """SELECT album_id, COUNT(*) FILTER (WHERE NOT has_file AND COALESCE(total, 0) >= 0.87) AS n_matched, COUNT(*) FILTER (WHERE has_file) AS n_present,
 COUNT(*) FILTER (WHERE NOT has_file AND COALESCE(total, 0) < 0.87) AS n_missing, COUNT(*) AS total,
 round_even(100.0 * (COUNT(*) FILTER (WHERE has_file OR COALESCE(total, 0) >= 0.87)) / COUNT(*), 1) AS pct"""


@query("agg_plan_album", _PLAN + " FROM plan_scored GROUP BY album_id")
def agg_plan_album(t):
    return R.agg_plan_album(*_plan_inputs(t), fuzzy=False)[1]


@query("agg_plan_album_fuzzy")
def agg_plan_album_fuzzy(t):
    return R.agg_plan_album(*_plan_inputs(t), fuzzy=True)[1]


@query("agg_plan_tracks", """
SELECT album_id, track_id, CASE WHEN has_file THEN 'present' WHEN COALESCE(total, 0) >= 0.87 THEN 'matched' ELSE 'missing' END AS state,
 CASE WHEN NOT has_file AND COALESCE(total, 0) >= 0.87 THEN path END AS source FROM plan_scored""")
def agg_plan_tracks(t):
    return R.agg_plan_album(*_plan_inputs(t), fuzzy=False)[0].drop("score")


@query("agg_plan_refresh", _PLAN + """ FROM (SELECT album_id, has_file, CASE WHEN total >= 0.87 AND ordinal % 3 = 0 THEN 0.0 ELSE total END AS total FROM plan_scored) GROUP BY album_id""")
def agg_plan_refresh(t):
    rows = R.agg_plan_album(*_plan_inputs(t), fuzzy=False)[0]
    live = t.titles.filter("id % 3 <> 0").select(F.concat(F.lit("src/"), F.col("id").cast("string")).alias("path"))
    return R.agg_plan_refresh(rows, live)[1]


@query("agg_needed_files", """
WITH p AS (SELECT DISTINCT CAST(l_partkey AS STRING) AS source, l_orderkey AS album_id FROM lineitem WHERE l_linestatus = 'O')
SELECT source, album_id, COUNT(*) OVER (PARTITION BY source) AS n_albums FROM p""")
def agg_needed_files(t):
    return R.agg_needed_files(t.lineitem.filter("l_linestatus = 'O'").select(F.col("l_partkey").cast("string").alias("source"), F.col("l_orderkey").alias("album_id")))


DERIVED["bundle_dirs"] = """
SELECT hash, CASE WHEN line IN (6, 7) THEN regexp_replace(path, '/[^/]*/[^/]*$', '') ELSE regexp_replace(path, '/[^/]*$', '') END AS album_dir, path, size FROM files
"""


@query("agg_bundle_plan", f"""
SELECT hash, album_dir, COUNT(*) FILTER (WHERE {D.ext('path')} IN {AUDIO}) AS n_audio, COUNT(*) AS n_files, CAST(SUM(size) AS BIGINT) AS size
FROM bundle_dirs GROUP BY 1, 2 HAVING COUNT(*) FILTER (WHERE {D.ext('path')} IN {AUDIO}) > 0""")
def agg_bundle_plan(t):
    return R.agg_bundle_plan(t.files.select("hash", K.key_path_album_dir("path", "hash").alias("album_dir"), "path", "size"))


def _judged(t):
    judged = J.join_four_gates(t.songs, t.wants)
    return judged.join(t.wants.select(F.col("ordinal").alias("want_ordinal"), "album"), "want_ordinal", "left")


@query("agg_match_summary", """
SELECT COUNT(*) AS scanned, COUNT(want_ordinal) AS matched, COUNT(DISTINCT album) AS albums, COUNT(*) FILTER (WHERE want_ordinal IS NULL) AS rejected,
 COUNT(*) FILTER (WHERE reason = 'no title tag') AS untagged FROM judged""")
def agg_match_summary(t):
    return R.agg_match_summary(_judged(t))


@query("agg_match_rejects", "SELECT ordinal, reason FROM judged WHERE want_ordinal IS NULL AND reason <> 'title not wanted by any album'")
def agg_match_rejects(t):
    return R.agg_match_rejects(J.join_four_gates(t.songs, t.wants))


@query("agg_match_report", """
SELECT album, ordinal, want_ordinal, delta_ms, COUNT(*) OVER (PARTITION BY album) AS n_matched, row_number() OVER (PARTITION BY album ORDER BY delta_ms, ordinal) AS rank FROM judged WHERE want_ordinal IS NOT NULL""")
def agg_match_report(t):
    return R.agg_match_report(_judged(t)).select("album", "ordinal", "want_ordinal", "delta_ms", "n_matched", "rank")


@query("agg_full_album_gate", """
WITH c AS (SELECT album_id, track_id, song_id FROM tracks WHERE suppkey % 6 <> 0 AND album_id % 7 <> 0 AND track_monitored),
n AS (SELECT album_id, COUNT(DISTINCT track_id) AS n FROM c GROUP BY 1), tot AS (SELECT album_id, COUNT(*) AS total FROM tracks GROUP BY 1)
SELECT c.track_id, c.album_id, n.n AS n_supplied FROM c JOIN n ON c.album_id = n.album_id JOIN tot ON c.album_id = tot.album_id AND tot.total = n.n""")
def agg_full_album_gate(t):
    c = t.tracks.select("album_id", "track_id", F.when(F.col("suppkey") % 6 != 0, F.col("suppkey")).alias("release_id"),
                        F.when(~F.col("track_monitored"), 1).otherwise(0).alias("n_rejections"), F.col("track_id").alias("path"))
    totals = t.tracks.groupBy("album_id").agg(F.count("*").alias("total"))
    allowed = t.tracks.filter("album_id % 7 <> 0").select("album_id")
    return R.agg_full_album_gate(c, totals, allowed).select("track_id", "album_id", "n_supplied")


@query("agg_majority", """
SELECT source, lang, n_identified, n_total FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = '' THEN 1 ELSE 0 END, n DESC, f) AS rn,
 CAST(SUM(CASE WHEN lang = '' THEN 0 ELSE n END) OVER (PARTITION BY source) AS BIGINT) AS n_identified, CAST(SUM(n) OVER (PARTITION BY source) AS BIGINT) AS n_total
 FROM (SELECT source, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END AS lang, COUNT(*) AS n, MIN(doc_id) AS f FROM documents GROUP BY 1, 2)) WHERE rn = 1""")
def agg_majority(t):
    d = t.documents.select("doc_id", "source", F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("lang")).alias("lang"))
    return R.agg_majority(d, group="source", value="lang", ordinal="doc_id")


@query("agg_signature", """
SELECT user_id, COUNT(*) || ':' || CAST(SUM(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) || ':' || CAST(MAX(CAST(floor(epoch(ts)) AS BIGINT)) AS BIGINT) AS signature FROM events GROUP BY user_id""")
def agg_signature(t):
    e = t.events.select("user_id", F.floor(F.col("value") * 100).cast("bigint").alias("size"), epoch_s("ts").alias("mtime"))
    return R.agg_signature(e, group="user_id", size="size", modified="mtime")


@query("agg_set_signature")
def agg_set_signature(t):
    return R.agg_set_signature(t.tracks.filter("NOT has_file"), group=["album_id"], item="track_id")


_UP = D.ancestors("path")


@query("agg_dir_rollup", f"""
WITH x AS (SELECT unnest(list_concat([''], {_UP})) AS dir, size FROM files) SELECT dir, CAST(SUM(size) AS BIGINT) AS size, COUNT(*) AS n_files FROM x GROUP BY dir""")
def agg_dir_rollup(t):
    return R.agg_dir_rollup(t.files)


@query("agg_dir_delta", f"""
WITH x AS (SELECT unnest(list_concat([''], {_UP})) AS dir, size FROM files WHERE suppkey % 7 <> 2) SELECT dir, CAST(SUM(size) AS BIGINT) AS size, COUNT(*) AS n_files FROM x GROUP BY dir""")
def agg_dir_delta(t):
    gone = t.files.filter("suppkey % 7 = 2").groupBy(R.parent_dir("path").alias("dir")).agg((-F.sum("size")).alias("d_size"), (-F.count("*")).alias("d_files"))
    return R.agg_dir_delta(R.agg_dir_rollup(t.files), gone)


@query("agg_dir_listing", f"""
WITH x AS (SELECT unnest({_UP}) AS dir, size FROM files), d AS (SELECT dir, CAST(SUM(size) AS BIGINT) AS size, COUNT(*) AS n FROM x GROUP BY dir)
SELECT CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '' END AS parent, dir AS name, 'folder' AS kind, size, n AS n_files FROM d
UNION ALL SELECT regexp_replace(path, '/[^/]*$', ''), path, 'file', size, 1 FROM files""")
def agg_dir_listing(t):
    return R.agg_dir_listing(R.agg_dir_rollup(t.files), t.files)


DERIVED["jobs"] = """
SELECT event_id AS job_id, 'dir' || (user_id % 37) AS dir, event_id AS added,
 CASE event_type WHEN 'error' THEN 'running' WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'failed' ELSE 'done' END AS state, CAST(event_id % 101 AS DOUBLE) AS pct FROM events
"""


@query("agg_job_progress", """
WITH p AS (SELECT dir, CASE WHEN dir IS NULL THEN 1 ELSE 0 END AS overall, COUNT(*) AS total, COUNT(*) FILTER (WHERE state NOT IN ('running', 'queued')) AS done, COUNT(*) FILTER (WHERE state = 'running') AS running,
 COUNT(*) FILTER (WHERE state = 'queued') AS queued, round_even(100.0 * round(SUM(CASE state WHEN 'running' THEN pct / 100 WHEN 'queued' THEN 0.0 ELSE 1.0 END), 9) / COUNT(*), 1) AS pct FROM jobs GROUP BY ROLLUP (dir))
SELECT *, CASE WHEN overall = 0 THEN row_number() OVER (PARTITION BY overall ORDER BY running DESC, pct, dir) END AS rank FROM p""")
def agg_job_progress(t):
    return R.agg_job_progress(t.jobs)


@query("agg_job_window", """
SELECT job_id, state, row_number() OVER (ORDER BY CASE state WHEN 'running' THEN 0 ELSE 1 END, added, job_id) AS place FROM jobs WHERE state IN ('running', 'queued')
UNION ALL SELECT job_id, state, row_number() OVER (ORDER BY added DESC, job_id DESC) FROM jobs WHERE state NOT IN ('running', 'queued')""")
def agg_job_window(t):
    return R.job_window(t.jobs).select("job_id", "state", "place")


@query("agg_badges", """
WITH p AS (SELECT album_id, 100.0 * have / total AS pct, artist_id % 3 = 0 AS hunting FROM albums WHERE total > 0) SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE pct >= 100) AS complete, COUNT(*) FILTER (WHERE hunting) AS hunting FROM p""")
def agg_badges(t):
    p = t.albums.filter("total > 0").select((F.lit(100.0) * F.col("have") / F.col("total")).alias("pct"), (F.col("artist_id") % 3 == 0).alias("hunting"))
    return R.agg_badges(p)


@query("agg_audio_majority", f"""
SELECT hash, COUNT(*) FILTER (WHERE {D.ext('path')} IN {AUDIO}) AS n_audio, COUNT(*) AS n_files FROM files WHERE CAST(substr(hash, 2) AS INTEGER) % 4 <> 0 GROUP BY hash
HAVING COUNT(*) FILTER (WHERE {D.ext('path')} IN {AUDIO}) > 0 AND 2 * COUNT(*) FILTER (WHERE {D.ext('path')} IN {AUDIO}) >= COUNT(*)""")
def agg_audio_majority(t):
    f = t.files.select("hash", "path", F.when(F.substring("hash", 2, 9).cast("int") % 4 == 0, "music").otherwise(" ").alias("category"))
    return R.agg_audio_majority(f)


@query("agg_title_coverage", """
WITH a AS (SELECT album_id, COUNT(DISTINCT song_id) AS n FROM tracks GROUP BY 1), h AS (SELECT album_id, suppkey % 3 AS release_id, COUNT(DISTINCT song_id) AS hit FROM tracks WHERE NOT has_file GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY hit DESC, release_id) AS rn FROM h)
SELECT a.album_id, b.release_id, round(COALESCE(hit, 0) / n, 6) AS coverage, CASE WHEN COALESCE(hit, 0) / n >= 0.6 THEN 'accept' WHEN COALESCE(hit, 0) / n < 0.25 THEN 'reject' ELSE 'unsure' END AS verdict
FROM a LEFT JOIN b ON a.album_id = b.album_id AND b.rn = 1""")
def agg_title_coverage(t):
    songs = t.tracks.select("album_id", F.col("song_id").cast("string").alias("title_key"), (F.col("suppkey") % 3).alias("release_id"), "has_file")
    return R.agg_title_coverage(songs.filter("NOT has_file"), songs)


@query("agg_category_totals", f"""
WITH c AS (SELECT {D.ext('path')} AS category, COUNT(*) AS n, CAST(SUM(size) AS BIGINT) AS bytes FROM files GROUP BY ROLLUP (1))
SELECT category, CASE WHEN category IS NULL THEN 1 ELSE 0 END AS overall, n, bytes, CASE WHEN bytes < 1024 THEN printf('%.1f B', bytes::DOUBLE) WHEN bytes < 1024 ** 2 THEN printf('%.1f KB', bytes / 1024) WHEN bytes < 1024 ** 3 THEN printf('%.1f MB', bytes / 1024 ** 2)
 WHEN bytes < 1024 ** 4 THEN printf('%.1f GB', bytes / 1024 ** 3) ELSE printf('%.1f TB', bytes / 1024 ** 4) END AS shown FROM c""")
def agg_category_totals(t):
    return R.agg_category_totals(t.files.select(K.file_ext("path").alias("category"), "size"))


@query("agg_format_profile", f"""
WITH f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, {D.ext('path')} AS format, size, qty % 7 AS channels, 16 + qty % 9 AS bits FROM files),
c AS (SELECT dir, format, COUNT(*) AS n FROM f GROUP BY 1, 2), m AS (SELECT dir, string_agg(format || '=' || n, ',' ORDER BY format) AS formats FROM c GROUP BY 1)
SELECT f.dir, MIN(m.formats) AS formats, COUNT(*) AS n_files, bool_and(format IN {D.in_list(fixed.LOSSLESS_EXT)}) AS lossless, NOT bool_and(format IN {D.in_list(fixed.LOSSLESS_EXT)}) AS has_lossy, MAX(channels) > 2 AS multichannel,
 MAX(channels) AS max_channels, MAX(bits) AS max_bits, CAST(SUM(size) AS BIGINT) AS bytes FROM f JOIN m ON f.dir = m.dir GROUP BY f.dir""")
def agg_format_profile(t):
    f = t.files.select(R.parent_dir("path").alias("dir"), K.file_ext("path").alias("format"), "size", (F.col("qty") % 7).alias("channels"),
                       (16 + F.col("qty") % 9).alias("bits"), F.lit(44100).alias("rate")).withColumn("lossless", F.col("format").isin(*fixed.LOSSLESS_EXT))
    text = F.array_join(F.transform(F.map_entries("formats"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return R.agg_format_profile(f).withColumn("formats", text).drop("max_rate")
