"""Bindings of windows, set operations and decision tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.bindings import duck as D
from ledgerline.bindings.registry import DERIVED, query
from ledgerline.functions import fixed, keys as K, predicates as P
from ledgerline.functions.text import epoch_s
from ledgerline.operators import decisions as X, joins as J, ranking as W, rollups as R, sets as S

AUDIO = D.in_list(fixed.AUDIO_EXT_DOWNLOADS)
DAY = 86400


# --- picks ------------------------------------------------------------------------------
@query("win_best_per_source", """
SELECT l_partkey, l_orderkey AS want, delta FROM (SELECT l_partkey, l_orderkey, CAST(floor(abs(l_extendedprice - 50000) * 100) AS BIGINT) AS delta,
 row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(floor(abs(l_extendedprice - 50000) * 100) AS BIGINT), l_orderkey) AS rn FROM lineitem) WHERE rn = 1""")
def win_best_per_source(t):
    pairs = t.lineitem.select("l_partkey", F.col("l_orderkey").alias("want"), F.floor(F.abs(F.col("l_extendedprice") - 50000) * 100).cast("bigint").alias("delta"))
    return W.win_best_per_source(pairs, source="l_partkey", value="delta", ordinal="want")


@query("win_one_per_track", """
SELECT ordinal, want_ordinal, delta_ms, CASE WHEN row_number() OVER (PARTITION BY want_ordinal ORDER BY delta_ms, ordinal) = 1 THEN 'matched' ELSE 'duplicate' END AS outcome
FROM judged WHERE want_ordinal IS NOT NULL""")
def win_one_per_track(t):
    """Flagship: songs matched with wanted tracks, one source per track."""
    judged = J.join_four_gates(t.songs, t.wants, reasons=False)
    return W.win_one_per_track(judged).select("ordinal", "want_ordinal", "delta_ms", "outcome")


@query("win_runner_up", """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nxt FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, nxt AS runner_up, round(o_totalprice - COALESCE(nxt, 0), 4) AS margin FROM r WHERE rn = 1""")
def win_runner_up(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return W.win_runner_up(o, group="o_custkey", score="o_totalprice", ordinal="o_orderkey").withColumn("margin", F.round("margin", 4))


DERIVED["sheet_rows"] = """
SELECT l_orderkey AS sheet_id, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey AS position, CAST(floor(l_extendedprice / 100) AS DOUBLE) + l_linenumber * CASE WHEN l_orderkey % 2 = 0 THEN 2000.0 ELSE 100.0 END AS start_s,
 CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 14000.0 END AS duration_s FROM lineitem
"""


@query("win_sheet_end_times", """
SELECT sheet_id, position, start_s, COALESCE(lead(start_s) OVER (PARTITION BY sheet_id ORDER BY position, start_s), duration_s) AS end_s FROM sheet_rows""")
def win_sheet_end_times(t):
    return W.win_sheet_end_times(t.sheet_rows).drop("duration_s")


@query("win_sheet_validity", """
WITH l AS (SELECT sheet_id, position, start_s, COALESCE(lag(start_s) OVER (PARTITION BY sheet_id ORDER BY position, start_s), -1.0) AS prev FROM sheet_rows),
a AS (SELECT sheet_id, COUNT(*) AS n, bool_and(start_s >= prev) AS rising, bool_and(start_s > prev) AS strict, arg_max(start_s, position) AS last_start FROM l GROUP BY 1),
s AS (SELECT o_orderkey AS sheet_id, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS title, o_orderkey % 3 AS n_files, o_orderstatus = 'P' AS sep, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 14000.0 END AS duration_s FROM orders),
r AS (SELECT s.*, COALESCE(n, 0) AS n, COALESCE(rising, false) AS rising, CASE WHEN n_files = 0 THEN 'no file reference' WHEN n_files > 1 THEN 'several files' WHEN sep THEN 'file in a subfolder' WHEN COALESCE(n, 0) < 2 THEN 'too few tracks'
 WHEN NOT strict THEN 'starts not increasing' WHEN last_start + 1.0 > duration_s THEN 'audio too short' END AS reason FROM s LEFT JOIN a ON s.sheet_id = a.sheet_id)
SELECT sheet_id, n > 0 AND title <> '' AND rising AS valid, reason IS NULL AS disc_image, reason FROM r""")
def win_sheet_validity(t):
    k = F.col("o_orderkey")
    sheets = t.orders.select(k.alias("sheet_id"), F.when(k % 13 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), (k % 3).alias("n_files"),
                             (F.col("o_orderstatus") == "P").alias("has_separator"), F.when(k % 5 != 0, 14000.0).alias("duration_s"))
    return W.win_sheet_validity(t.sheet_rows.drop("duration_s"), sheets)


@query("win_budget", """
WITH b AS (SELECT doc_id, n_chars, CAST(COALESCE(SUM(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM documents)
SELECT doc_id, n_chars, before, least(greatest(2000000 - before, 0), n_chars) AS taken FROM b""")
def win_budget(t):
    return W.win_budget(t.documents.select("doc_id", "n_chars"), ordinal="doc_id", files="n_chars", budget=2_000_000)


DERIVED["candidates"] = """
SELECT l_orderkey % 3000 AS album, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ordinal, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) % 11 / 10.0 AS score,
 CAST(floor(l_quantity) AS BIGINT) % 7 AS seeders, CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS leechers, l_returnflag = 'A' AS lossless, CASE WHEN l_linenumber = 3 THEN 'usenet' ELSE 'Torrent' END AS protocol FROM lineitem
"""


@query("win_rank_candidates", """
SELECT album, ordinal, rank FROM (SELECT album, ordinal, CAST(row_number() OVER (PARTITION BY album ORDER BY CASE WHEN seeders + leechers > 0 THEN 1 ELSE 0 END DESC, floor(round(score / 0.1, 9)) DESC, lossless DESC, seeders + 0.3 * leechers DESC, ordinal) AS INTEGER) AS rank FROM candidates)""")
def win_rank_candidates(t):
    return W.win_rank_candidates(t.candidates, group="album").select("album", "ordinal", "rank")


@query("rank_by_seeders", """
SELECT album, ordinal, seeders FROM (SELECT *, row_number() OVER (PARTITION BY album ORDER BY seeders DESC, ordinal) AS rn FROM candidates WHERE protocol = 'Torrent' AND seeders >= 2) WHERE rn <= 3""")
def rank_by_seeders(t):
    return W.rank_by_seeders(t.candidates, group="album", min_seeders=2, k=3).select("album", "ordinal", "seeders")


@query("win_rotation", """
WITH l AS (SELECT c_custkey, MAX(CAST(floor(epoch(ts)) AS BIGINT)) AS last FROM customer LEFT JOIN events ON c_custkey = user_id AND event_type = 'view' GROUP BY 1)
SELECT c_custkey, last, row_number() OVER (ORDER BY COALESCE(last, 0), c_custkey) AS turn FROM l WHERE last IS NULL OR 1706700000 - last >= 43200""")
def win_rotation(t):
    e = t.events.filter("event_type = 'view'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max(epoch_s("ts")).alias("last"))
    items = t.customer.select("c_custkey").join(e, "c_custkey", "left")
    return W.win_rotation(items, last="last", ordinal="c_custkey", now=1706700000, cooldown=43200)


@query("win_newest_first", "SELECT o_orderkey, substr(CAST(o_orderdate AS STRING), 1, 10) AS arrived, row_number() OVER (ORDER BY substr(CAST(o_orderdate AS STRING), 1, 10) DESC, o_orderkey) AS rank FROM orders")
def win_newest_first(t):
    o = t.orders.select("o_orderkey", F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("arrived"))
    return W.win_newest_first(o, arrived="arrived", ordinal="o_orderkey")


DERIVED["medians"] = """
SELECT orderkey, COUNT(*) AS n, MAX(size) AS largest, list_sort(list(size), 'DESC')[COUNT(*) // 2 + 1] AS median FROM files GROUP BY orderkey
"""


@query("win_cheap_first", "SELECT orderkey, n, largest, median, n >= 2 AND median > 0 AND largest < 3 * median AS cheap FROM medians")
def win_cheap_first(t):
    return W.win_cheap_first(t.files, group="orderkey", size="size")


@query("win_first_by_key", """
SELECT hash, path, file_id FROM (SELECT hash, path, file_id, row_number() OVER (PARTITION BY hash, path ORDER BY file_id) AS rn FROM files) WHERE rn = 1""")
def win_first_by_key(t):
    return W.win_first_by_key(t.files.select("hash", "path", "file_id"), keys=["hash", "path"], ordinal="file_id")


@query("win_best_edition", """
SELECT p_name, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY abs(p_size - 12), p_partkey) AS rn FROM part) WHERE rn = 1""")
def win_best_edition(t):
    p = t.part.select("p_name", "p_partkey", "p_size", F.lit(12).alias("target"))
    return W.win_best_edition(p, group="p_name", count="p_size", target="target", ordinal="p_partkey").drop("target")


@query("win_sorted_plans", """
SELECT album_id, artist, pct, row_number() OVER (ORDER BY pct DESC, artist, album_id) AS rank FROM (SELECT album_id, CAST(artist_id AS STRING) AS artist, round(100.0 * have / total, 1) AS pct FROM albums WHERE total > 0)""")
def win_sorted_plans(t):
    p = t.albums.filter("total > 0").select("album_id", F.col("artist_id").cast("string").alias("artist"), F.round(F.lit(100.0) * F.col("have") / F.col("total"), 1).alias("pct"))
    return W.win_sorted_plans(p)


# --- sets ---------------------------------------------------------------------------------
@query("set_keep_union", "SELECT path FROM files WHERE orderkey % 5 = 0 UNION SELECT path FROM files WHERE partkey % 7 = 0 UNION SELECT path FROM files WHERE suppkey % 9 = 0")
def set_keep_union(t):
    f = t.files
    return S.set_keep_union(f.filter("orderkey % 5 = 0"), f.filter("partkey % 7 = 0"), f.filter("suppkey % 9 = 0"))


_FLAGS = f"""SELECT file_id, hash, orderkey % 3 = 0 AS owned, {D.ext('path')} IN ('mkv', 'vob') AS video, partkey % 151 = 0 AS needed, orderkey % 7 = 0 AS wanted, {D.ext('path')} IN {AUDIO} AS audio, line = 1 AS dropped_before FROM files"""
DERIVED["flags"] = _FLAGS
DERIVED["drops"] = """
SELECT f.*, ((owned OR video) AND NOT needed) OR (s.some AND audio AND NOT needed AND NOT wanted) AS drop FROM flags f JOIN (SELECT hash, bool_or(needed) AS some FROM flags GROUP BY hash) s ON f.hash = s.hash
"""


def _flags(t):
    ext = K.file_ext("path")
    return t.files.select("file_id", "hash", (F.col("orderkey") % 3 == 0).alias("owned"), ext.isin("mkv", "vob").alias("video"), (F.col("partkey") % 151 == 0).alias("needed"),
                          (F.col("orderkey") % 7 == 0).alias("wanted"), P.is_audio_file("path").alias("audio"), (F.col("line") == 1).alias("dropped_before"))


@query("set_drop_merge", "SELECT file_id, drop, drop AND NOT dropped_before AS apply FROM drops")
def set_drop_merge(t):
    return S.set_drop_merge(_flags(t)).select("file_id", "drop", "apply")


@query("set_prune_to", """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS kept FROM customer""")
def set_prune_to(t):
    present = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    kept, gone = S.set_prune_to(t.customer.select("c_custkey"), present, key="c_custkey")
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


@query("set_census_diff", """
WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 10 <> 0 GROUP BY 1)
SELECT a.o_custkey, a.n AS before, b.n AS after, CASE WHEN b.n IS NULL THEN 'lost' ELSE 'shrunk' END AS change FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey WHERE b.n IS NULL OR b.n < a.n""")
def set_census_diff(t):
    n = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return S.set_census_diff(n(t.orders), n(t.orders.filter("o_orderstatus <> 'P' AND o_custkey % 10 <> 0")), key="o_custkey", value="n")


# --- decisions -------------------------------------------------------------------------------
DERIVED["downloads"] = """
SELECT a.album_id, 'root/f' || (a.album_id % 50) || '/' || a.album_id AS path, CASE a.album_id % 7 WHEN 0 THEN 'CD' || (a.album_id % 3) WHEN 1 THEN 'Scans' ELSE 'Album ' || a.album_id END AS name,
 CASE WHEN a.album_id % 4 = 3 THEN 0 ELSE a.have END AS n_audio, a.album_id % 11 = 0 AS has_video, a.album_id % 13 = 0 AS has_disc_child, a.have > 0 AND a.have >= a.total AS complete,
 CASE WHEN a.monitored THEN a.total ELSE 0 END AS total, (a.album_id % 300) * 1000000 AS size, 1000000 + a.album_id % 1000 AS newest FROM albums a
"""
DERIVED["classes"] = """
SELECT *, CASE WHEN has_video THEN 'skipped video' WHEN n_audio > 0 THEN CASE WHEN complete AND total >= n_audio THEN CASE WHEN name LIKE 'CD%' THEN 'review' ELSE 'dupe' END WHEN total = 0 THEN 'unmatched' ELSE 'partial' END
 WHEN lower(name) = 'scans' OR has_disc_child THEN 'left alone' WHEN size <= 104857600 THEN 'shell' ELSE 'left alone' END AS class FROM downloads
"""


@query("dec_download_class", "SELECT album_id, class FROM classes")
def dec_download_class(t):
    return X.dec_download_class(t.downloads).select("album_id", "class")


@query("dec_purgeable", "SELECT album_id, path FROM classes WHERE class = 'dupe' AND 1000900 - newest >= 300")
def dec_purgeable(t):
    return X.dec_purgeable(X.dec_download_class(t.downloads), now=1000900).select("album_id", "path")


DERIVED["bundle_plan"] = """
SELECT album_id, album_id % 6 = 0 AS noise, album_id % 10 = 0 AS unofficial, have > 0 AND have >= total AS complete, CASE WHEN monitored THEN total ELSE 0 END AS total, have + artist_id % 3 AS n_audio, total + artist_id % 2 AS room FROM albums
"""


@query("dec_deselect", """
SELECT album_id, CASE WHEN (noise OR unofficial) AND total > 0 AND NOT complete THEN 'wanted though unofficial' WHEN noise OR unofficial THEN 'unofficial' WHEN complete AND total >= n_audio THEN 'owned'
 WHEN complete AND room >= n_audio THEN 'bigger edition fits' WHEN complete THEN 'bigger edition fits nowhere' WHEN total = 0 THEN 'not in catalogue' ELSE 'incomplete' END AS reason FROM bundle_plan""")
def dec_deselect(t):
    return X.dec_deselect(t.bundle_plan).select("album_id", "reason")


@query("dec_useless_bundle", """
SELECT hash, CASE WHEN na > 0 AND nk = 0 THEN 'remove' WHEN na = 0 AND nv > 0 THEN 'remove and ban' ELSE 'keep' END AS action FROM (
 SELECT hash, COUNT(*) FILTER (WHERE audio) AS na, COUNT(*) FILTER (WHERE audio AND NOT drop) AS nk, COUNT(*) FILTER (WHERE video) AS nv FROM drops GROUP BY hash)""")
def dec_useless_bundle(t):
    return X.dec_useless_bundle(S.set_drop_merge(_flags(t))).select("hash", "action")


DERIVED["finished"] = """
SELECT o_orderkey AS hash, CASE WHEN o_orderkey % 9 = 0 THEN 0.5 ELSE 1.0 END AS progress, o_orderkey % 5 AS n_selected, o_orderkey % 7 <> 0 AS folder_exists, o_orderkey % 4 AS n_on_disk, 1000 + o_orderkey % 600 AS newest,
 CASE o_orderstatus WHEN 'P' THEN 'PausedUP' ELSE 'uploading' END AS state FROM orders
"""


@query("dec_lifecycle", """
WITH p AS (SELECT l_orderkey AS hash, COUNT(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus <> 'F') AS nb, COUNT(*) FILTER (WHERE l_linestatus = 'F') AS no FROM lineitem GROUP BY 1)
SELECT b.hash, CASE WHEN progress < 1 THEN 'nothing: downloading' WHEN n_selected = 0 THEN 'nothing: no audio selected' WHEN NOT folder_exists THEN 'remove entry' WHEN n_on_disk = 0 THEN 'remove with data'
 WHEN COALESCE(nb, 0) = 0 AND COALESCE(no, 0) >= 1 AND 1700 - newest >= 300 THEN 'remove with data' WHEN n_on_disk < n_selected AND state <> 'PausedUP' THEN 'pause' ELSE 'keep' END AS action
FROM finished b LEFT JOIN p ON b.hash = p.hash""")
def dec_lifecycle(t):
    albums = t.lineitem.select(F.col("l_orderkey").alias("hash"), (F.col("l_linestatus") == "F").alias("have"), F.when(F.col("l_returnflag") == "R", 0).otherwise(9).alias("total"))
    return X.dec_lifecycle(t.finished, albums, t.files.select("path"), now=1700).select("hash", "action")


NOW = 1706745600
DERIVED["latest"] = """
SELECT user_id AS hash, MIN(CAST(floor(epoch(ts)) AS BIGINT)) AS added, MAX(CAST(floor(epoch(ts)) AS BIGINT)) AS last_activity, arg_max(event_type, event_id) AS state, arg_max(value, event_id) / 400 AS progress,
 COUNT(*) % 3 AS num_seeds, COUNT(*) % 2 AS num_complete FROM events GROUP BY user_id
"""


def _latest(t):
    e = t.events.select("user_id", "event_id", epoch_s("ts").alias("s"), "event_type", "value")
    return e.groupBy(F.col("user_id").alias("hash")).agg(
        F.min("s").alias("added"), F.max("s").alias("last_activity"), F.max_by("event_type", "event_id").alias("state"),
        (F.max_by("value", "event_id") / 400).alias("progress"), (F.count("*") % 3).alias("num_seeds"), (F.count("*") % 2).alias("num_complete"))


@query("dec_dead", f"""
SELECT hash FROM latest WHERE progress < 0.01 AND (state = 'error' OR (state IN ('view') AND num_seeds = 0 AND num_complete <= 0)) AND {NOW} - added >= 172800""")
def dec_dead(t):
    b = _latest(t).withColumn("state", F.when(F.col("state") == "view", "forcedDL").otherwise(F.col("state")))
    return X.dec_dead(b, now=NOW).select("hash")


@query("dec_stalled", f"""
WITH u AS (SELECT user_id AS hash, COUNT(*) AS n FROM events WHERE event_id % 3 <> 0 AND value >= 100 AND (event_type = 'signup' OR event_id % 10 = 1) GROUP BY 1)
SELECT l.hash, COALESCE(u.n, 0) AS n_useful, CASE WHEN COALESCE(u.n, 0) > 0 THEN 'salvage' ELSE 'trash' END AS action FROM latest l LEFT JOIN u ON l.hash = u.hash
WHERE progress >= 0.01 AND progress < 1 AND state <> 'purchase' AND {NOW} - last_activity >= 60000""")
def dec_stalled(t):
    b = _latest(t).withColumn("state", F.when(F.col("state") == "purchase", "pausedDL").otherwise(F.col("state")))
    files = t.events.select(F.col("user_id").alias("hash"), (F.col("value") / 100).alias("progress"), (F.col("event_id") % 3 != 0).alias("audio"),
                            (F.col("event_type") == "signup").alias("needed"), (F.col("event_id") % 10 == 1).alias("wanted"))
    return X.dec_stalled(b, files, now=NOW, grace_s=60000).select("hash", "n_useful", "action")


@query("dec_leftovers", f"""
SELECT CASE WHEN status = 'F' THEN 'imported' WHEN partkey % 5 = 0 AND {D.ext('path')} IN {AUDIO} THEN 'still wanted' ELSE 'leftover' END AS fate, COUNT(*) AS n_files, CAST(SUM(size) AS BIGINT) AS bytes FROM files GROUP BY 1""")
def dec_leftovers(t):
    f = t.files.select(F.col("file_id").alias("path"), "size", P.is_audio_file("path").alias("audio"))
    done = t.files.filter("status = 'F'").select(F.col("file_id").alias("path"))
    want = t.files.filter("partkey % 5 = 0").select(F.col("file_id").alias("path"))
    return X.leftover_totals(X.dec_leftovers(f, done, want))


@query("dec_removable_bundles", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def dec_removable_bundles(t):
    b = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("category"))
    return X.removable_bundles(b, " 1-Urgent ").unionByName(X.removable_bundles(b, "")).select("o_orderkey")


@query("dec_prefer_lossless", """
SELECT orderkey, line, file_id FROM files f WHERE flag <> 'A' AND EXISTS (SELECT 1 FROM files g WHERE g.orderkey = f.orderkey AND g.line = f.line AND g.flag = 'A')""")
def dec_prefer_lossless(t):
    f = t.files.select(F.col("orderkey").alias("album_id"), F.col("line").alias("track_no"), "file_id", (F.col("flag") == "A").alias("lossless"))
    return X.dec_prefer_lossless(f).select(F.col("album_id").alias("orderkey"), F.col("track_no").alias("line"), "file_id")


@query("dec_library_audit", """
WITH d AS (SELECT l_orderkey AS album_id, COUNT(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), c AS (SELECT album_id, have, total FROM albums WHERE artist_id % 6 <> 0),
b AS (SELECT COALESCE(d.album_id, c.album_id) AS album_id, COALESCE(n, 0) AS n_disk, COALESCE(have, 0) AS have, total FROM d FULL JOIN c ON d.album_id = c.album_id)
SELECT album_id, n_disk, have, COALESCE(total, 0) AS total, CASE WHEN total IS NULL THEN 'missing record' WHEN n_disk > 0 AND have = 0 THEN 'zero files' WHEN n_disk > have THEN 'under-registered' WHEN n_disk = 0 AND have > 0 THEN 'not on disk' ELSE 'ok' END AS class FROM b""")
def dec_library_audit(t):
    disk = t.lineitem.filter("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("album_id")).agg(F.count("*").alias("n_disk"))
    return X.dec_library_audit(disk, t.albums.filter("artist_id % 6 <> 0").select("album_id", "have", "total"))


@query("dec_import_admission", """
WITH c AS (SELECT album_id, total, total + artist_id % 5 - 2 AS n_files FROM albums)
SELECT album_id, CASE WHEN total <= 0 THEN 'unknown release' WHEN n_files = total THEN 'exact' WHEN n_files < total AND (total - n_files) / total <= 0.10 THEN 'nearly complete' WHEN n_files > total AND (n_files - total) / total <= 0.25 THEN 'extras'
 WHEN n_files > total THEN 'compilation' WHEN n_files / total >= 0.50 THEN 'partial: keep source' ELSE 'refuse' END AS verdict FROM c""")
def dec_import_admission(t):
    c = t.albums.select("album_id", "total", (F.col("total") + F.col("artist_id") % 5 - 2).alias("n_files"))
    # a NULL ratio (no total) is caught by the first branch
    c = c.withColumn("total", F.nullif(F.col("total"), F.lit(0)))
    return X.dec_import_admission(c).select("album_id", "verdict")


@query("dec_image_folder", """
SELECT m.orderkey, CASE WHEN (n = 1 OR largest >= 3 * median) AND p.q >= 20 THEN 'disc image' ELSE 'split' END AS kind FROM medians m JOIN (SELECT orderkey, arg_max(qty, size) AS q FROM files GROUP BY 1) p ON m.orderkey = p.orderkey""")
def dec_image_folder(t):
    return X.dec_image_folder(t.files, group="orderkey", size="size", playing="qty", min_s=20).select("orderkey", "kind")


@query("dec_prefer_multichannel", """
SELECT p_partkey, p_partkey = first_value(p_partkey) OVER (PARTITION BY p_name ORDER BY p_size % 7 DESC, p_partkey DESC) OR MAX(p_size % 7) OVER (PARTITION BY p_name) <= 2 AS keep FROM part""")
def dec_prefer_multichannel(t):
    p = t.part.select(F.col("p_name").alias("parent"), F.col("p_partkey").alias("folder"), (F.col("p_size") % 7).alias("channels"))
    return X.dec_prefer_multichannel(p).select(F.col("folder").alias("p_partkey"), "keep")


@query("dec_held_vs_library", """
WITH q AS (SELECT p_partkey AS id, round(CASE WHEN p_type <> 'SMALL' THEN 2 ELSE 0 END + CASE WHEN p_size % 7 > 2 THEN 2 ELSE 0 END + (p_size % 7) / 10 + p_size / 100 + 0.0044100, 9) AS r FROM part),
h AS (SELECT a.id AS held_id, a.id // 2 AS album_id, a.r, b.r AS l FROM q a LEFT JOIN q b ON b.id = a.id // 2 AND b.id % 5 <> 0),
v AS (SELECT held_id, album_id, CASE WHEN l IS NULL THEN 'not in library' WHEN r > l THEN 'better' WHEN r < l THEN 'worse' ELSE 'same' END AS verdict FROM h)
SELECT held_id, album_id, verdict, CASE WHEN verdict = 'not in library' AND held_id % 2 = 0 THEN row_number() OVER (PARTITION BY verdict = 'not in library' AND held_id % 2 = 0 ORDER BY held_id) END AS turn FROM v""")
def dec_held_vs_library(t):
    q = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_type") != "SMALL").alias("lossless"), (F.col("p_size") % 7).alias("channels"), F.col("p_size").alias("bits"), F.lit(44100).alias("rate"))
    held = q.withColumn("held_id", F.col("id")).withColumn("album_id", F.floor(F.col("id") / 2)).withColumn("monitored", F.col("id") % 2 == 0).drop("id")
    return X.dec_held_vs_library(held, q.filter("id % 5 <> 0").withColumnRenamed("id", "album_id"))


@query("dec_convert_selection", f"""
SELECT CASE WHEN {D.ext('path')} IN {D.in_list(fixed.LOSSLESS_EXT)} THEN 'encode' ELSE 'copy' END AS action, COUNT(*) AS n FROM files GROUP BY 1""")
def dec_convert_selection(t):
    f = t.files.select(K.file_ext("path").alias("format"))
    return X.dec_convert_selection(f, lossless_only=True, copy_lossy=True).groupBy("action").agg(F.count("*").alias("n"))


@query("dec_verdict_diff", """
WITH o AS (SELECT album_id, class FROM classes WHERE album_id % 17 <> 0), n AS (SELECT album_id, CASE WHEN class = 'partial' AND n_audio = total THEN 'dupe' ELSE class END AS class FROM classes WHERE album_id % 19 <> 0)
SELECT COALESCE(o.album_id, n.album_id) AS album_id, o.class AS old, n.class AS new FROM o FULL JOIN n ON o.album_id = n.album_id WHERE o.class IS DISTINCT FROM n.class""")
def dec_verdict_diff(t):
    c = X.dec_download_class(t.downloads)
    new = c.withColumn("class", F.when((F.col("class") == "partial") & (F.col("n_audio") == F.col("total")), "dupe").otherwise(F.col("class")))
    return X.dec_verdict_diff(c.filter("album_id % 17 <> 0"), new.filter("album_id % 19 <> 0"), key="album_id", verdict="class")
