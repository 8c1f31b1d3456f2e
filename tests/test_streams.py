"""Streams over several micro-batches, in any order, give what their batch twins give; snapshots lose no writer's work."""

import random
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import state as T
from ledgerline.sources import sinks
from ledgerline.streaming import machines as M, streams

DDL = "key long, at timestamp, ord long, signature string, done boolean, progress double, gone boolean"
NAMES = ["key", "ms", "ord", "signature", "done", "progress", "gone"]
ROWS = DDL.replace("at timestamp", "ms long")
MIN = 60_000


def _events(seed, n=240, keys=6):
    """Events of ``n`` minutes, some at one time, as ``(key, ms, ord, signature, done, progress, gone)``."""
    rng = random.Random(seed)
    return [(rng.randrange(keys), (1000 + rng.randrange(n)) * MIN, i, str(rng.randrange(2)), rng.random() < 0.02, rng.choice([0.0, 0.0, 0.0, 0.0, 0.0, 0.5]), rng.random() < 0.85) for i in range(n)]


def _run(spark, events, machine, values, seed, batches=4, late=20):
    """Rows of a machine on a stream of events that come up to ``late`` minutes late, and how many rows of state are left."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rng = random.Random(seed)
    arrived = sorted(events, key=lambda e: e[1] + rng.randrange(late) * MIN)
    step = -(-len(arrived) // batches)
    for i in range(batches + 1):
        part = arrived[i * step:(i + 1) * step] if i < batches else [(None, 10**6 * MIN, *[None] * 5)]
        rows = spark.createDataFrame(part, ROWS)
        rows.select("key", F.timestamp_millis("ms").alias("at"), "ord", "signature", "done", "progress", "gone").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = M.in_event_time(stream, machine, key="key", at="at", ordinal="ord", values=values, delay=f"{late} minutes")
    query = streams.run_to_table(out, f"{folder}/out", f"{folder}/mark")
    assert len({p["batchId"] for p in query.recentProgress}) >= batches
    return sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{folder}/out").collect()), key=str), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def _plain(events, machine, values, end=10**6 * MIN):
    """The machine on all events at once, in order."""
    out = []
    for key in sorted({e[0] for e in events}):
        mine, state = sorted((e for e in events if e[0] == key), key=lambda e: (e[1], e[2])), None
        while True:
            due = machine.due(state) if state is not None else None
            if mine and (due is None or mine[0][1] <= due):
                e, mine = mine[0], mine[1:]
                more = {"ordinal": e[2]} if isinstance(machine, M.Throttle) else {}
                state, rows = machine.event(state, e[1], tuple(e[NAMES.index(v)] for v in values), **more)
            elif due is not None and due < end:
                state, rows = machine.expired(state, due)
            else:
                break
            out += [(key, *r) for r in rows]
    return sorted(out, key=str)


MACHINES = [
    (M.FirstMissing(wait_ms=30 * MIN, forget_ms=10**4 * MIN), ("gone",)),
    (M.DeadTimer(grace_ms=15 * MIN, forget_ms=10**4 * MIN), ("progress",)),
    (M.IdleTimer(grace_ms=8 * MIN, forget_ms=10**4 * MIN), ("ord",)),
    (M.Throttle(recheck_ms=11 * MIN, forget_ms=10**4 * MIN), ("signature", "done")),
    (M.TtlLedger(ttl_ms=9 * MIN, max_attempts=2, keep_ms=10**4 * MIN), ("signature",)),
    (M.CompleteOnce(forget_ms=10**4 * MIN), ("done",)),
    (M.ChangeGate(forget_ms=10**4 * MIN), ("signature",)),
]


@pytest.mark.parametrize("machine, values", MACHINES, ids=lambda m: type(m).__name__)
def test_machines(spark, machine, values):
    events = _events(1)
    got, left = _run(spark, events, machine, values, seed=2)
    assert got == _plain(events, machine, values) and got
    assert left == 0  # all state has ended by itself


def test_a_key_costs_few_messages():
    """One read for each call, a write and a move of the timer only where they changed."""
    sent, box = [], [None]

    class Value:
        def get(self):
            sent.append("get")
            return box[0]

        def update(self, value):
            sent.append("update")
            box[0] = value

        def clear(self):
            sent.append("clear")
            box[0] = None

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            sent.append("register")

        def deleteTimer(self, at):
            sent.append("delete")

    run = M.InEventTime(M.ChangeGate(forget_ms=1000))
    run.init(Handle())
    steps = []
    for new, watermark in (([(50, 1, "a")], 10), ([], 20), ([(60, 2, "b")], 20), ([], 55), ([], 5000)):
        steps.append(([tuple(r) for r in run._advance((7,), new, watermark)], sent[:]))
        sent.clear()
    assert steps == [([], ["get", "update", "register"]), ([], ["get"]), ([], ["get", "update"]),
                     ([(7, 50, "a")], ["get", "update", "delete", "register"]), ([(7, 60, "b")], ["get", "clear", "delete"])]


def test_batches_do_not_matter(spark):
    events, machine = _events(3), M.IdleTimer(grace_ms=8 * MIN, forget_ms=10**4 * MIN)
    assert _run(spark, events, machine, ("ord",), seed=4, batches=3) == _run(spark, events, machine, ("ord",), seed=5, batches=6)


def test_machines_next_to_batch_operators(spark):
    """The batch twins at a time ``now``, after the last event."""
    events, now = _events(6), 1500 * MIN
    table = spark.createDataFrame(events, ROWS).withColumnRenamed("ms", "ts")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    plan = T.st_recheck_throttle(table, key="key", ts="ts", signature="signature", done="done", recheck_s=11 * MIN, ordinal="ord").select("key", "ts", "ord", "signature")
    assert rows(plan) == _plain(events, MACHINES[3][0], ("signature", "done"))
    once = T.st_complete_once(table, key="key", ts="ts", complete="done")
    assert rows(once) == _plain(events, MACHINES[5][0], ("done",))
    idle = T.st_idle_timer(table, key="key", ts="ts", now=now, grace_s=8 * MIN + 1)
    told = _plain(events, MACHINES[2][0], ("ord",))
    assert rows(idle) == sorted([r for r in told if r[2]] + [(k, a, now) for k, a, b in told if b is None and not any(x[:2] == (k, a) and x[2] for x in told)], key=str)


def _held(seed):
    rng = random.Random(seed)
    return [(f"path/{rng.randrange(4)}", rng.randrange(50), i, rng.choice(["", "A", "B", None]), rng.choice(["", "why " + str(i)]),
             rng.choice([None, "{}", '{"a": %d}' % i, '{"a": "x%d", "b": [1, %d]}' % (i, i)])) for i in range(60)]


@pytest.mark.parametrize("seed", range(3))
def test_held_updates_merge_in_any_order(spark, seed):
    rng = random.Random(seed + 10)
    held = _held(seed)
    frame = lambda part: spark.createDataFrame(part, "source_path string, ts long, ordinal long, artist string, reason string, d string").withColumn("details", F.parse_json("d"))
    fold = lambda part: T.st_held_fold(frame(part), fields=("artist", "reason"), details="details")
    show = lambda df: sorted(map(tuple, T.st_held_rows(df).withColumn("details", F.to_json("details")).select("source_path", "artist", "reason", "created", "updated", "seen_count", "details").collect()))
    whole = show(fold(held))
    rng.shuffle(held)
    cuts = [held[:7], held[7:25], held[25:26], held[26:]]
    rng.shuffle(cuts)
    merged = fold(cuts[0])
    for part in cuts[1:]:
        merged = T.st_held_merge(merged, fold(part))
    assert show(merged) == whole
    batch = T.st_upsert_held(frame(held), fields=("artist", "reason"))
    assert sorted(map(tuple, batch.select("source_path", "artist", "reason", "created", "updated", "seen_count").collect())) == [r[:-1] for r in whole]


def test_change_gate_judges_what_was_committed(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, rows in enumerate(([(1, "a", 1), (2, "a", 2)], [(1, "a", 3), (2, "b", 4), (2, "c", 5)], [(3, "a", 6)])):
        spark.createDataFrame(rows, "key long, signature string, ts long").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("key long, signature string, ts long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    seen = []
    streams.gate_changes(stream, f"{folder}/ledger", f"{folder}/mark", lambda changed: seen.append(sorted(map(tuple, changed.collect()))))
    assert seen == [[(1, "a"), (2, "a")], [(2, "c")], [(3, "a")]]
    assert sorted(map(tuple, sinks.read_snapshot(spark, f"{folder}/ledger").select("key", "signature").collect())) == [(1, "a"), (2, "c"), (3, "a")]


def test_snapshot_versions(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    assert sinks.read_snapshot(spark, folder) is None and sinks.snapshot_version(spark, folder) is None
    for n in range(1, 7):
        assert sinks.sink_snapshot_swap(spark.range(n), folder) == n
    assert sinks.read_snapshot(spark, folder).count() == 6
    assert sinks._Log(spark, folder).versions() == [4, 5, 6]
    import os
    assert len([x for x in os.listdir(folder) if x.startswith("v=")]) == 3


def test_a_replayed_batch_changes_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    add = lambda old: spark.range(1) if old is None else old.union(spark.range(1))
    assert sinks.commit_snapshot(spark, folder, add, stream="s", batch=0) == 1
    assert sinks.commit_snapshot(spark, folder, add, stream="s", batch=0) is None
    assert sinks.commit_snapshot(spark, folder, add, stream="other", batch=0) == 2
    assert sinks.commit_snapshot(spark, folder, lambda old: old.limit(0), stream="s", batch=1) == 3
    assert sinks.commit_snapshot(spark, folder, add, stream="s", batch=1) is None  # though it left no rows
    assert sinks.read_snapshot(spark, folder).count() == 0


def test_writers_at_once_lose_nothing(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    tried = []

    def writer(me):
        for i in range(3):
            def step(old, me=me, i=i):
                tried.append((me, i))
                new = spark.createDataFrame([(f"{me}-{i}",)], "who string")
                return new if old is None else old.union(new)
            sinks.commit_snapshot(spark, folder, step, stream=str(me), batch=i, keep=50)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["who"] for r in sinks.read_snapshot(spark, folder).collect()) == sorted(f"{k}-{i}" for k in range(3) for i in range(3))
    assert sinks.snapshot_version(spark, folder) == 9 and len(tried) >= 9


def test_first_sightings_of_three_producers(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rng = random.Random(7)
    reports = [(f"sheet {i}", p) for i in range(19) for p in rng.sample(["scan", "watch", "manual"], 2)] + [(f"sheet {rng.randrange(19)}", "scan") for _ in range(10)]
    rng.shuffle(reports)
    assert len(reports) == 48

    def run():
        streams_of = {p: spark.readStream.schema("key string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/{p}") for p in ("scan", "watch", "manual")}
        streams.first_sightings(streams_of, f"{folder}/ledger", f"{folder}/mark", key="key")
        return streams.read_sightings(spark, f"{folder}/ledger", spark.createDataFrame([], "key string, producer string").schema).collect()

    counts = []
    for part in (reports[:20], reports[20:21], reports[21:]):  # started anew for each
        for p in ("scan", "watch", "manual"):
            mine = [(k,) for k, q in part if q == p]
            spark.createDataFrame(mine, "key string").repartition(2).write.mode("append").parquet(f"{folder}/{p}")
        counts.append(len(run()))
        assert counts[-1] == len({k for k, _ in reports[:{1: 20, 2: 21, 3: 48}[len(counts)]]})
    assert counts[-1] == 19 and len(run()) == 19


def test_sheets_in_every_encoding(spark):
    from ledgerline.functions import fixed
    from ledgerline.sources import readers

    rng = random.Random(8)
    texts = [("utf-8-sig", "TITLE é"), ("utf-8", "TITLE Ж 夜"), ("cp1251", "TITLE Жизнь"), ("cp1252", "“quoted” ˜"), ("shift_jis", "表題 日本語テスト"), ("gb18030", "标题 中文"), ("iso-8859-1", "caf\xe9 \x98\x81")]
    raws = [t.encode(e) for e, t in texts] + [b"", None, b"\xef\xbb\xbf\xef\xbb\xbfx", b"\xff\xfe\x98\x81\x30", b"\x98\xff\xff\x81"] + [bytes(rng.choice([65, 66, 0x98, 0x81, 0x8D, 0xE9, 0xC3, 0xA9, 0xFF, 0x30]) for _ in range(rng.randrange(9))) for _ in range(400)]

    def plain(raw):
        if raw is None:
            return None, None
        for name in fixed.SHEET_ENCODINGS:
            try:
                return raw.decode(name), name
            except UnicodeDecodeError:
                pass
        return raw.decode("utf-8", errors="replace"), "replaced"

    got = readers.decode_sheets(spark.createDataFrame([(i, None if r is None else bytearray(r)) for i, r in enumerate(raws)], "i int, content binary")).collect()
    assert {r["i"]: (r["text"], r["encoding"]) for r in got} == {i: plain(r) for i, r in enumerate(raws)}
