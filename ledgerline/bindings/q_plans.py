"""Bindings of the flows: several operators after another, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.bindings import duck as D
from ledgerline.bindings.q_rollups import _PLAN, _plan_inputs
from ledgerline.bindings.registry import DERIVED, query
from ledgerline.plans import assembly, harvest

NOW = 1706745600

# songs on disk by folder, what a ledger has judged already, and the tracks that the catalogue still wants
DERIVED["folder_songs"] = """
SELECT s.*, 'f' || (d % 40) AS key, 's' || (d % 3) AS signature FROM (SELECT *, CAST(split_part(ordinal, '-', 4) AS BIGINT) AS d FROM songs) s
"""
DERIVED["fresh_songs"] = """
SELECT * FROM folder_songs f WHERE NOT (f.key IN ('f1', 'f7', 'f12') AND f.signature = 's1')
"""
DERIVED["wanted_tracks"] = f"""
SELECT t.track_id AS ordinal, t.title, t.artist, 'Album ' || t.album_id AS album, t.duration_ms FROM tracks t JOIN albums a ON t.album_id = a.album_id
WHERE a.monitored AND (a.total = 0 OR a.have < a.total) AND NOT t.has_file AND t.track_monitored AND {D.compact_title('t.title')} <> ''
"""
# the keys, gates and verdicts of the gate match, over these
for _name, _base in (("fresh_keys", "song_keys"), ("wanted_keys", "want_keys"), ("fresh_gated", "gated"), ("fresh_judged", "judged")):
    _text = DERIVED[_base]
    for _old, _new in (("song_keys", "fresh_keys"), ("want_keys", "wanted_keys"), ("gated", "fresh_gated"), ("FROM songs", "FROM fresh_songs"), ("FROM wants", "FROM wanted_tracks")):
        _text = _text.replace(f"FROM {_old}", f"FROM {_new}").replace(f"JOIN {_old}", f"JOIN {_new}") if not _old.startswith("FROM") else _text.replace(_old, _new)
    DERIVED[_name] = _text


@query("plan_harvest", """
SELECT ordinal, want_ordinal, delta_ms, CASE WHEN want_ordinal IS NULL THEN 'rejected' WHEN row_number() OVER (PARTITION BY want_ordinal ORDER BY delta_ms, ordinal) = 1 THEN 'matched' ELSE 'duplicate' END AS outcome,
 CASE WHEN want_ordinal IS NULL THEN reason END AS reason FROM fresh_judged""")
def plan_harvest(t):
    """Songs of folders that the ledger has not judged yet, against the tracks still wanted; one source per track."""
    judged = t.spark.createDataFrame([("f1", "s1"), ("f7", "s1"), ("f12", "s1")], "key string, signature string")
    tracks = t.tracks.withColumn("ordinal", F.col("track_id")).withColumn("album", F.concat(F.lit("Album "), F.col("album_id").cast("string")))
    return harvest.harvest(t.folder_songs, tracks, t.albums, ledger=judged).select("ordinal", "want_ordinal", "delta_ms", "outcome", "reason")


@query("plan_assembly", f"""
WITH p AS (SELECT s.* FROM plan_scored s JOIN plan_tracks t ON s.track_id = t.track_id WHERE t.various OR t.want_artist IN (SELECT strong FROM plan_sources WHERE strong <> '')),
n AS ({_PLAN} FROM p GROUP BY album_id), o AS (SELECT o_orderkey AS id, 7 AS created FROM orders WHERE o_orderkey % 3 = 0)
SELECT COALESCE(n.album_id, o.id) AS id, COALESCE(n_matched, 0) AS n_matched, COALESCE(n_present, 0) AS n_present, COALESCE(n_missing, 0) AS n_missing, COALESCE(n.total, 0) AS total, COALESCE(pct, 0.0) AS pct, COALESCE(o.created, {NOW}) AS created
FROM n FULL JOIN o ON n.album_id = o.id""")
def plan_assembly(t):
    """Plans of albums whose artist the sources know, merged into the plans stored before."""
    zero = {c: F.lit(0).cast("long") for c in ("n_matched", "n_present", "n_missing", "total")}
    stored = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), *(v.alias(c) for c, v in zero.items()), F.lit(0.0).alias("pct"), F.lit(7).cast("long").alias("created"))
    return assembly.plan_albums(*_plan_inputs(t), stored, now=NOW, fuzzy=False)[1]
