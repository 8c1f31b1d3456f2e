"""Repair of conversations with the fewest edits: rank-convergence parallel Viterbi.

The turns of a conversation must spell ``(s?(ua)+)?`` in initials of roles.  A
turn may be kept, given the other role, or deleted, and turns may be inserted;
what an edit costs depends on the turn.  The least cost from each turn on is a
vector of four numbers, one for each state of the pattern, computed backwards.

Turns in order are cut into chunks of ``CHUNK``, and all chunks start at once
from a guessed cost vector of what follows them.  A fix-up pass gives each chunk
the vector that its successor has found; where that differs from the one it
used by more than a constant, it runs again.  A few turns make all vectors
parallel, so passes end after a few rounds, however long a conversation is.
What was subtracted is added up to the cost.  Each chunk then maps the state in
which it is entered to that in which it is left; these maps are composed
pairwise, and every chunk traces its cheapest edits from its true state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import n_tasks, staged

#: turns in a chunk, a power of two
CHUNK = 64
_BITS = CHUNK.bit_length() - 1

#: fixed values: costs of edits, faults in order of precedence, pairs of initials that may stand together
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 2, 3, 2, 1
FAULTS = ("blank", "duplicate", "truncated")
LEGAL = ("su", "ua", "au")

#: states: nothing yet, after system, after user, after assistant.  Cost of what must still be inserted at the end
START, SYSTEM, USER, ASSISTANT = range(4)
AT_END = (0, 2 * INSERT, INSERT, 0)

#: no turn: fills up the codes of a short chunk
_NONE = 255

_FAR = 1 << 40


def _closed(v: np.ndarray) -> np.ndarray:
    """Costs where turns may be inserted first."""
    v[:, USER] = np.minimum(v[:, USER], v[:, ASSISTANT] + INSERT)
    for s in (START, SYSTEM, ASSISTANT):
        v[:, s] = np.minimum(v[:, s], v[:, USER] + INSERT)
    return v


def costs(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs ``(chunk, turn, state)`` from each turn on, the last ones ``ends``.

    ``codes`` has a row for each chunk; a turn's code is its role (0 system, 1
    user, 2 assistant, 3 other) plus 4 times its fault's number (0 none).
    """
    out = np.empty((len(codes), codes.shape[1] + 1, 4), np.int64)
    out[:, -1] = ends
    for t in range(codes.shape[1] - 1, -1, -1):
        code, after = codes[:, t], out[:, t + 1]
        role, fault = code & 3, code >> 2
        now = after + DELETE
        extra = np.where(fault == 3, LEFT_TRUNCATED, 0) + np.where((fault == 1) | (fault == 2), _FAR, 0)
        to_user = after[:, USER] + extra + np.where(role == 1, 0, REROLE)
        to_assistant = after[:, ASSISTANT] + extra + np.where(role == 2, 0, REROLE)
        to_system = after[:, SYSTEM] + extra + np.where(role == 0, 0, _FAR)
        now[:, START] = np.minimum(np.minimum(now[:, START], to_system), to_user)
        now[:, SYSTEM] = np.minimum(now[:, SYSTEM], to_user)
        now[:, USER] = np.minimum(now[:, USER], to_assistant)
        now[:, ASSISTANT] = np.minimum(now[:, ASSISTANT], to_user)
        out[:, t] = np.where((code == _NONE)[:, None], after, _closed(now))
    return out


def traced(codes: list[int], cost: list[list[int]], state: int, last: bool) -> tuple[list[str], list[str], int]:
    """The ASCII-least of the cheapest edits of each turn, the roles these give, and the state after them.

    A turn's edits are the insertions before it and its own; those of the last
    turn of a conversation go on with the insertions that end it.  Roles: u, a,
    k for the turn's own, - for none.
    """
    edits, roles = [], []
    for t, code in enumerate(codes):
        role, fault = code & 3, code >> 2
        mine, given = "", ""
        while True:
            here, after = cost[t][state], cost[t + 1]
            to = ASSISTANT if state == USER else USER
            extra = LEFT_TRUNCATED if fault == 3 else 0
            if here == after[state] + DELETE:
                mine, given = mine + "D", given + "-"
                break
            if here == cost[t][to] + INSERT:
                mine, given, state = mine + "I", given + "ua"[to - USER], to
                continue
            if state == START and role == 0 and here == after[SYSTEM] + extra:
                mine, given, state = mine + "K", given + "k", SYSTEM
            elif role == to - 1 and here == after[to] + extra:
                mine, given, state = mine + "K", given + "k", to
            else:
                mine, given, state = mine + "R", given + "ua"[to - USER], to
            break
        edits.append(mine)
        roles.append(given)
    while last and AT_END[state]:
        state = ASSISTANT if state == USER else USER
        edits[-1] += "I"
        roles[-1] += "ua"[state - USER]
    return edits, roles, state


def _padded(column: pa.Array) -> np.ndarray:
    out = np.full((len(column), CHUNK), _NONE, np.int64)
    for i, codes in enumerate(column.to_pylist()):
        out[i, :len(codes)] = codes
    return out


_CHUNKS = "g long, key {key}, first boolean, last boolean, codes array<int>, end array<long>, start array<long>"


def _run(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``start``, the cost vector that follows from ``end``."""
    names = ["g", "key", "first", "last", "codes", "end"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.array(batch.column("end").to_pylist(), np.int64).reshape(-1, 4)
            start = costs(_padded(batch.column("codes")), ends)[:, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(start.tolist(), pa.list_(pa.int64()))], [*names, "start"])

    return chunks.select(*names).mapInArrow(work, _CHUNKS.format(key=chunks.schema["key"].dataType.simpleString()))


def _neighbour(chunks: DataFrame, other: DataFrame, by: int) -> DataFrame:
    """``chunks`` with the columns ``_...`` of ``other``'s chunk of the same conversation ``by`` further on, null where there is none."""
    there = other.select(*(F.col(c).alias(f"_{c}") for c in other.columns))
    return chunks.join(there, (F.col("g") + by == F.col("_g")) & F.col("key").eqNullSafe(F.col("_key")), "left")


def _converged(chunks: DataFrame) -> DataFrame:
    """All chunks with the vectors that their successors' give, each less its least component."""
    guess = F.array(*(F.lit(x).cast("long") for x in AT_END))
    now = staged(_run(chunks.withColumn("end", guess)), "vectors")
    alone = now.filter("first AND last")
    many = now.filter("NOT (first AND last)")
    while True:
        least = F.array_min("_start")
        seen = _neighbour(many, many.select("g", "key", "start"), 1).withColumn("_end", F.when(F.col("_start").isNull(), guess).otherwise(F.transform("_start", lambda x: x - least)))
        seen = staged(seen.select(*now.columns, "_end"), "vectors")
        stale = seen.filter("_end <> end")
        if stale.isEmpty():
            return alone.unionByName(seen.drop("_end"))
        rerun = _run(stale.withColumn("end", F.col("_end")))
        many = staged(seen.filter("_end = end").drop("_end").unionByName(rerun), "vectors")


def _left_states(chunks: DataFrame) -> DataFrame:
    """``g, key, left``: the state in which each chunk of a longer conversation is left."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.array(batch.column("end").to_pylist(), np.int64).reshape(-1, 4)
            found = costs(_padded(batch.column("codes")), ends).tolist()
            maps = []
            for codes, cost, last in zip(batch.column("codes").to_pylist(), found, batch.column("last").to_pylist()):
                # a short chunk's costs are those of its first turns: the rest are no turns
                maps.append([traced(codes, cost, s, last)[2] for s in range(4)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("g", "key", "first")), batch.column("g"), pa.array(maps, pa.list_(pa.int32()))], ["g", "key", "first", "back", "map"])

    kind = chunks.schema["key"].dataType.simpleString()
    now = staged(chunks.select("g", "key", "first", "last", "codes", "end").mapInArrow(work, f"g long, key {kind}, first boolean, back long, map array<int>"), "maps")
    # a map of the chunks from ``back`` to ``g``; known once it is constant or begins with the conversation
    known = F.col("first") | (F.size(F.array_distinct("map")) == 1)
    while not now.filter(~known).isEmpty():
        before = now.select(F.col("g").alias("_g"), F.col("key").alias("_key"), F.col("first").alias("_first"), F.col("back").alias("_back"), F.col("map").alias("_map"))
        todo = now.filter(~known).join(before, (F.col("back") - 1 == F.col("_g")) & F.col("key").eqNullSafe(F.col("_key")))
        joined = todo.select("g", "key", F.col("_first").alias("first"), F.col("_back").alias("back"), F.transform("_map", lambda s: F.get("map", s)).alias("map"))
        now = staged(now.filter(known).unionByName(joined), "maps")
    return now.select("g", "key", F.get("map", F.lit(START)).alias("left"))


def _edits(chunks: DataFrame) -> DataFrame:
    """``g, at, edits, roles`` of every turn of ``chunks`` (``g, codes, ats, end, last, entered``)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            found = costs(_padded(batch.column("codes")), np.array(cols["end"], np.int64).reshape(-1, 4)).tolist()
            out = [traced(codes, cost, s, last) for codes, cost, s, last in zip(cols["codes"], found, cols["entered"], cols["last"])]
            yield pa.RecordBatch.from_arrays([
                pa.array([g for g, codes in zip(cols["g"], cols["codes"]) for _ in codes], pa.int64()), pa.array([a for ats in cols["ats"] for a in ats], pa.int32()),
                pa.array([e for o in out for e in o[0]], pa.string()), pa.array([r for o in out for r in o[1]], pa.string())], ["g", "at", "edits", "roles"])

    return chunks.mapInArrow(work, "g long, at int, edits string, roles string")


def _initial(role: Column) -> Column:
    return F.left(role, F.lit(1))


def _placed(rows: DataFrame) -> DataFrame:
    """Turns in order: block ``g``, which holds ``CHUNK`` of them, and place ``at`` in it.

    Turns are sorted by ranges, so a long conversation is in many tasks.  A
    chunk is what a block has of one conversation; its successor is in the next
    block.
    """
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "role", "text", "copy")]
    ranges = rows.repartitionByRange(n_tasks(rows.sparkSession), *order).sortWithinPartitions(*order)
    stored = staged(ranges.withColumn("pos", F.monotonically_increasing_id()), "turns")
    part, row = F.shiftright("pos", 33), F.col("pos").bitwiseAND((1 << 33) - 1)
    placed = stored.withColumn("part", part).withColumn("block", F.shiftright(row, _BITS)).withColumn("at", row.bitwiseAND(CHUNK - 1).cast("int"))
    # a window over one row for each part that has turns
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg((F.max("block") + 1).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, "part").withColumn("g", F.col("offset") + F.col("block")).drop("pos", "part", "block", "offset")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired turns of conversations, and a report on each.

    ``rows``: ``key, turn, role, text, copy`` (``copy`` tells equal turns
    apart).  Turns are ordered by ``turn``, nulls first, then role, text and
    copy.  Turns: ``key, g, at, edits, lines``, a row for each turn of the
    input, in order of ``g, at``; ``edits`` are initials of Insert, Keep, Rerole
    and Delete, ``lines`` the ``edit, role, text`` that stay.  Report: ``key,
    gaps, blank, duplicate, truncated, illegal, cost``, all longs.

    Nulls in role and text count as one space.  A role is known by its initial;
    others, empty ones too, cannot be kept.  Repeated rows are duplicates of the
    first.  Null keys are one conversation.  Empty tables give empty results.
    Very long texts only cost their bytes; a conversation of any length is in
    many chunks.  Further columns are not read.
    """
    blank_if_null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    placed = _placed(rows.select("key", "turn", blank_if_null("role"), blank_if_null("text"), "copy"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    slim = placed.select("g", "at", "key", "turn", _initial(F.col("role")).alias("initial"), F.unhex(said).alias("said"),
                         (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("is_blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("is_truncated"))
    slim = staged(slim, "turns")
    firsts = slim.groupBy("key", "said").agg(F.min(F.struct("g", "at")).alias("f")).select("f.g", "f.at", F.lit(True).alias("is_first"))
    fault = F.when(F.col("is_blank"), 1).when(F.col("is_first").isNull(), 2).when(F.col("is_truncated"), 3).otherwise(0)
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    turns = staged(slim.join(firsts, ["g", "at"], "left").select("g", "at", "key", "turn", "initial", fault.alias("fault"), (role + 4 * fault).alias("code")), "turns")

    by_turn = turns.groupBy("key", "turn").agg(*(F.count(F.when(F.col("fault") == i + 1, 1)).alias(f) for i, f in enumerate(FAULTS)))
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count("turn")
    counted = by_turn.groupBy("key").agg(F.coalesce(span, F.lit(0)).try_cast("long").alias("gaps"), *(F.sum(f).alias(f) for f in FAULTS))

    listed = turns.groupBy("g", "key").agg(F.sort_array(F.collect_list(F.struct("at", "code", "initial"))).alias("rows"))
    chunks = listed.select("g", "key", F.col("rows.at").alias("ats"), F.col("rows.code").alias("codes"), F.col("rows.initial").alias("initials"))
    chunks = staged(chunks, "chunks")
    ends = chunks.select("g", "key", F.get("initials", F.lit(0)).alias("initial"))
    beside = _neighbour(chunks, ends, 1).withColumnRenamed("_initial", "_next").drop("_g", "_key")
    beside = staged(_neighbour(beside, ends.select("g", "key"), -1).select(*chunks.columns, "_next", F.col("_g").isNull().alias("first"), F.col("_next").isNull().alias("last")), "chunks")
    line = F.when(F.col("last"), F.col("initials")).otherwise(F.array_append("initials", F.col("_next")))
    pairs = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.concat(a, b))
    illegal = beside.select("key", F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))).alias("n")).groupBy("key").agg(F.sum("n").cast("long").alias("illegal"))

    final = staged(_converged(beside.select("g", "key", "first", "last", "codes")), "vectors")
    cost = final.groupBy("key").agg(F.sum(F.when(F.col("first"), F.get("start", F.lit(START))).otherwise(F.array_min("start"))).alias("cost"))
    entered = _neighbour(final.drop("start"), _left_states(final.filter("NOT (first AND last)")), -1).select(*final.drop("start").columns, F.coalesce("_left", F.lit(START)).alias("entered"))
    ats = chunks.select(F.col("g").alias("_g"), F.col("key").alias("_key"), "ats")
    whole = entered.join(ats, (F.col("g") == F.col("_g")) & F.col("key").eqNullSafe(F.col("_key")))
    edits = _edits(whole.select("g", "codes", "ats", "end", "last", "entered"))

    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    new_role = lambda given, own: F.when(given == "k", own).when(given == "u", "user").when(given == "a", "assistant")
    ops = F.filter(F.arrays_zip(letters("edits").alias("e"), letters("roles").alias("r")), lambda x: x["e"] != "D")
    lines = F.transform(ops, lambda x: F.struct(x["e"].alias("edit"), new_role(x["r"], F.col("role")).alias("role"), F.when(x["e"] == "I", "").otherwise(F.col("text")).alias("text")))
    out = placed.join(edits, ["g", "at"]).select("key", "g", "at", "edits", lines.alias("lines"))

    same = lambda a, b: a["key"].eqNullSafe(b["key"])
    report = counted.join(illegal, same(counted, illegal)).drop(illegal["key"])
    return out, report.join(cost, same(report, cost)).drop(cost["key"])


def digests(turns: DataFrame) -> DataFrame:
    """``key, audit, sha256``: all edits of a conversation, and the SHA-256 of its lines ``role:text``.

    Such a digest takes a conversation's bytes in order: they stream through
    one task, which keeps no line.
    """
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    flat = turns.select("key", "g", "at", "edits", F.when(F.size("lines") > 0, text).alias("line"))
    kind = flat.schema["key"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, audit, digest, empty = None, None, [], None, True

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], schema), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["key", "audit", "sha256"])

        for batch in batches:
            schema = batch.column(0).type
            for key, edits, line in zip(batch.column("key").to_pylist(), batch.column("edits").to_pylist(), batch.column("line")):
                if now != (key,):
                    if now:
                        yield done()
                    now, audit, digest, empty = (key,), [], hashlib.sha256(), True
                audit.append(edits)
                if line.is_valid:
                    digest.update((b"" if empty else b"\n") + line.as_py().encode("utf-8", "surrogatepass"))
                    empty = False
        if now:
            yield done()

    sorted_turns = flat.repartition(n_tasks(flat.sparkSession), "key").sortWithinPartitions("key", "g", "at")
    return sorted_turns.mapInArrow(work, f"key {kind}, audit string, sha256 string")


def damaged(table: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key, turn, role, text, copy`` of a table with one turn in four spoilt, by a hash of key and turn.

    Nulls count as one space, but a null turn stays null for the order.
    """
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(string(key), F.lit(":"), string(turn)).cast("binary")) % 20
    rows = table.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), string(role).alias("role"), string(text).alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    spoilt = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("key", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), spoilt.alias("text"), F.explode(copies).alias("copy"))
