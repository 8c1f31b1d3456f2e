"""Bindings of the event-time machines: the events arrive in several micro-batches, out of order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.bindings.q_state import _THROTTLE, _drain, _ev, _scratch
from ledgerline.bindings.registry import DERIVED, query
from ledgerline.functions.text import epoch_s
from ledgerline.operators import state as S
from ledgerline.sources import sinks
from ledgerline.streaming import machines as M, streams

H = 3_600_000

#: how far an event may arrive behind later ones, and how many micro-batches there are before the clock's last tick
LATE_S, BATCHES = 86_400, 4

DERIVED["ev_ms"] = "SELECT event_id, user_id AS key, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS ms FROM events"


def arriving(t):
    """The events as a stream: dealt by a delay of up to ``LATE_S`` into files of one micro-batch each, then a tick far ahead."""
    folder = _scratch(t, "arriving")
    s = epoch_s("ts")
    e = t.events.select("event_id", "user_id", "event_type", "value", F.timestamp_seconds(s).alias("at"), (s + F.pmod(F.xxhash64("event_id"), F.lit(LATE_S))).alias("arrival"))
    lo, hi = e.agg(F.min("arrival"), F.max("arrival")).first()
    batch = F.least(F.floor((F.col("arrival") - (lo or 0)) * BATCHES / ((hi or 0) - (lo or 0) + 1)), F.lit(BATCHES - 1))
    files = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(BATCHES):
        e.filter(batch == i).drop("arrival").repartition(files).write.mode("append").parquet(folder)
    tick = t.spark.range(files).select(*(F.lit(None).cast(e.schema[c].dataType).alias(c) for c in ("event_id", "user_id", "event_type", "value")), F.timestamp_seconds(F.lit((hi or 0) + 200 * 86_400)).alias("at"))
    tick.repartition(files, "at").write.mode("append").parquet(folder)
    return t.spark.readStream.schema(e.drop("arrival").schema).option("maxFilesPerTrigger", files).parquet(folder)


def told(t, name, machine, *values):
    """What a machine tells of the arriving events, drained; values are columns or expressions."""
    stream = arriving(t).withColumns({f"_v{i}": v for i, v in enumerate(values)})
    out = M.in_event_time(stream, machine, key="user_id", at="at", ordinal="event_id", values=tuple(f"_v{i}" for i in range(len(values))), delay=f"{LATE_S + 60} seconds")
    return _drain(t, out, name)


MISSING = M.FirstMissing(wait_ms=72 * H)


@query("st_first_missing_stream", f"""
WITH e AS (SELECT *, event_type <> 'purchase' AS missing, COUNT(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY key ORDER BY ms, event_id) AS fills FROM ev_ms),
m AS (SELECT key, fills, MIN(ms) AS missing_since FROM e WHERE missing GROUP BY 1, 2),
f AS (SELECT key, fills - 1 AS fills, ms AS filled FROM e WHERE NOT missing)
SELECT m.key, missing_since, missing_since + {MISSING.wait_ms} AS eligible_at FROM m LEFT JOIN f ON f.key = m.key AND f.fills = m.fills WHERE filled IS NULL OR filled > missing_since + {MISSING.wait_ms}""")
def st_first_missing_stream(t):
    return told(t, "missing", MISSING, F.col("event_type") != "purchase")


DEAD = M.DeadTimer(grace_ms=48 * H)


@query("st_dead_timer_stream", f"""
WITH a AS (SELECT *, MIN(ms) OVER (PARTITION BY key) AS added FROM ev_ms)
SELECT key, added, MAX(value / 10000) AS best, added + {DEAD.grace_ms} AS dead_at FROM a WHERE ms <= added + {DEAD.grace_ms} GROUP BY key, added HAVING MAX(value / 10000) < {DEAD.least}""")
def st_dead_timer_stream(t):
    return told(t, "dead", DEAD, F.col("value") / 10000)


IDLE = M.IdleTimer(grace_ms=24 * H)


@query("st_idle_timer_stream", f"""
WITH n AS (SELECT key, ms AS idle_from, lead(ms) OVER (PARTITION BY key ORDER BY ms, event_id) AS idle_to FROM ev_ms), s AS (SELECT * FROM n WHERE idle_to IS NULL OR idle_to - idle_from > {IDLE.grace_ms})
SELECT key, idle_from, NULL AS idle_to FROM s UNION ALL SELECT key, idle_from, idle_to FROM s WHERE idle_to IS NOT NULL""")
def st_idle_timer_stream(t):
    return told(t, "idle-timer", IDLE, F.lit(0))


TTL = M.TtlLedger(ttl_ms=36 * H, max_attempts=3)


@query("st_ttl_stream", f"""
WITH RECURSIVE a AS (SELECT *, CAST(ms // 900000000 AS STRING) AS signature, row_number() OVER (PARTITION BY key ORDER BY ms, event_id) AS rn FROM ev_ms),
f AS (SELECT key, rn, ms, signature, ms AS examined, 1 AS attempts, 'new' AS why FROM a WHERE rn = 1
 UNION ALL SELECT a.key, a.rn, a.ms, a.signature, CASE WHEN a.signature <> f.signature OR (a.ms - f.examined >= {TTL.ttl_ms} AND f.attempts < {TTL.max_attempts}) THEN a.ms ELSE f.examined END,
  CASE WHEN a.signature <> f.signature THEN 1 WHEN a.ms - f.examined >= {TTL.ttl_ms} AND f.attempts < {TTL.max_attempts} THEN f.attempts + 1 ELSE f.attempts END,
  CASE WHEN a.signature <> f.signature THEN 'changed' WHEN a.ms - f.examined >= {TTL.ttl_ms} AND f.attempts < {TTL.max_attempts} THEN 'expired' END FROM f JOIN a ON a.key = f.key AND a.rn = f.rn + 1)
SELECT key, ms, signature, why, attempts FROM f WHERE why IS NOT NULL""")
def st_ttl_stream(t):
    return told(t, "ttl", TTL, F.floor(F.unix_millis("at") / 900_000_000).cast("string"))


@query("st_complete_once_stream", "SELECT key, MIN(ms) AS ms FROM ev_ms WHERE value > 200 GROUP BY key")
def st_complete_once_stream(t):
    return told(t, "complete", M.CompleteOnce(), F.col("value") > 200)


@query("st_change_gate_stream", """
SELECT key, ms, event_type AS signature FROM (SELECT *, lag(event_type) OVER (PARTITION BY key ORDER BY ms, event_id) AS last FROM ev_ms) WHERE last IS NULL OR last <> event_type""")
def st_change_gate_stream(t):
    return told(t, "gate", M.ChangeGate(), F.col("event_type"))


@query("st_idle_stream", """
SELECT user_id AS key, idle_from, idle_to FROM (SELECT user_id, s AS idle_from, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS idle_to FROM ev) WHERE idle_to - idle_from >= 86400""")
def st_idle_stream(t):
    spells = told(t, "idle", M.IdleTimer(grace_ms=24 * H - 1), F.lit(0)).filter("idle_to IS NOT NULL")
    return spells.select("key", *(F.expr(f"{c} div 1000").alias(c) for c in ("idle_from", "idle_to")))


@query("st_throttle_stream", _THROTTLE.replace("ts, event_id, signature FROM f WHERE", "ts, signature FROM f WHERE"))
def st_throttle_stream(t):
    planned = told(t, "throttle", M.Throttle(recheck_ms=12 * H), F.floor(F.unix_millis("at") / 400_000_000).cast("string"), F.col("value") > 150)
    return planned.select("key", F.expr("ms div 1000").alias("ts"), "signature")


@query("st_upsert_stream", """
WITH u AS (SELECT 'path/' || key AS source_path, ms // 1000 AS ts, event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS artist, event_type FROM ev_ms),
d AS (SELECT source_path, event_type, max(event_id) AS v FROM (SELECT *, row_number() OVER (PARTITION BY source_path, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM u) WHERE rn = 1 GROUP BY 1, 2)
SELECT source_path, COALESCE(arg_max(artist, (ts, event_id)) FILTER (WHERE artist <> ''), '') AS artist, MIN(ts) AS created, MAX(ts) AS updated, COUNT(*) AS seen_count,
 (SELECT '{' || string_agg('"' || event_type || '":' || v, ',' ORDER BY event_type) || '}' FROM d WHERE d.source_path = u.source_path) AS details FROM u GROUP BY 1""")
def st_upsert_stream(t):
    """Held items from batches that come late and out of order; each event adds a detail under its type."""
    i = F.col("event_id")
    detail = F.parse_json(F.concat(F.lit('{"'), "event_type", F.lit('": '), i.cast("string"), F.lit("}")))
    u = arriving(t).filter("event_id IS NOT NULL").select(F.concat(F.lit("path/"), F.col("user_id").cast("string")).alias("source_path"), F.expr("unix_millis(at) div 1000").alias("ts"), i.alias("ordinal"),
                                                          F.when(i % 3 == 0, "").otherwise(F.col("event_type")).alias("artist"), detail.alias("details"))
    folder = _scratch(t, "held")
    streams.upsert_held(u, folder, _scratch(t, "held-checkpoint"), fields=("artist",), details="details")
    return S.st_held_rows(sinks.read_snapshot(t.spark, folder)).withColumn("details", F.to_json("details")).drop("id")


@query("src_new_file_stream", "SELECT DISTINCT key AS user_id FROM ev_ms")
def src_new_file_stream(t):
    """Three producers report the same keys in several micro-batches; the query is started again after the last."""
    ledger, mark, schema = _scratch(t, "sightings"), _scratch(t, "sightings-checkpoint"), "key long, producer string"
    e = arriving(t)
    kinds = {"clicks": F.col("event_type") == "click", "views": F.col("event_type") == "view", "others": ~F.col("event_type").isin("click", "view")}
    for _ in range(2):
        streams.first_sightings({name: e.filter(kind) for name, kind in kinds.items()}, ledger, mark, key="user_id")
    return streams.read_sightings(t.spark, ledger, t.spark.createDataFrame([], schema).schema).select(F.col("key").alias("user_id"))
