"""Keyed state over streams, in event time.

A machine says what an event does to a key's state and what happens when its
time runs out.  ``in_event_time`` runs one on a stream: events wait until the
watermark has passed them and are then taken in order of time and ordinal,
together with the timers between them, whatever the micro-batches were.  State
ends by itself when a machine returns None.

All times are milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000

Step = tuple[tuple | None, list[tuple]]


@dataclass(frozen=True)
class Machine:
    """``value``, ``state`` and ``out`` are columns of an event's payload, of the state, and of the result after the key."""

    value = "v string"
    state = "at long"
    out = "ms long"

    def event(self, state: tuple | None, at: int, value: tuple) -> Step:
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When the state's time runs out."""
        return None

    def expired(self, state: tuple, at: int) -> Step:
        return None, []


@dataclass(frozen=True)
class FirstMissing(Machine):
    """Keys missing in every pass for ``wait_ms``: since when, and when that was reached.

    The clock stops when the item is there.  A key that stays missing is told
    once; after ``forget_ms`` more it is forgotten.
    """

    wait_ms: int
    forget_ms: int = 60 * DAY_MS
    value, state, out = "missing boolean", "since long, told boolean", "missing_since long, eligible_at long"

    def event(self, state, at, value):
        if not value[0]:
            return None, []
        return state or (at, False), []

    def due(self, state):
        return state[0] + self.wait_ms + (self.forget_ms if state[1] else 0)

    def expired(self, state, at):
        return (None, []) if state[1] else ((state[0], True), [(state[0], at)])


@dataclass(frozen=True)
class DeadTimer(Machine):
    """Keys without progress of ``least`` in the ``grace_ms`` after they were first seen; forgotten ``forget_ms`` after that."""

    grace_ms: int
    least: float = 0.01
    forget_ms: int = 60 * DAY_MS
    value, state, out = "progress double", "added long, best double, judged boolean", "added long, best double, dead_at long"

    def event(self, state, at, value):
        added, best, judged = state or (at, 0.0, False)
        return (added, max(best, value[0] or 0.0), judged), []

    def due(self, state):
        return state[0] + self.grace_ms + (self.forget_ms if state[2] else 0)

    def expired(self, state, at):
        added, best, judged = state
        return (None, []) if judged else ((added, best, True), [(added, best, at)] if best < self.least else [])


@dataclass(frozen=True)
class IdleTimer(Machine):
    """Keys silent for ``grace_ms``: told once, and with the end of the silence when an event ends it.

    After ``forget_ms`` of silence nothing more is told.
    """

    grace_ms: int
    forget_ms: int = 60 * DAY_MS
    value, state, out = "v int", "last long, told boolean", "idle_from long, idle_to long"

    def event(self, state, at, value):
        ended = [(state[0], at)] if state and state[1] else []
        return (at, False), ended

    def due(self, state):
        return state[0] + (self.forget_ms if state[1] else self.grace_ms)

    def expired(self, state, at):
        return (None, []) if state[1] else ((state[0], True), [(state[0], None)])


@dataclass(frozen=True)
class Throttle(Machine):
    """Sightings to plan: the first, a changed signature, or ``recheck_ms`` after the last planned; none after completion.

    A key not seen for ``forget_ms`` is forgotten.
    """

    recheck_ms: int
    forget_ms: int = 60 * DAY_MS
    value, state, out = "signature string, done boolean", "planned long, signature string, done boolean, seen long", "ms long, ord long, signature string"

    def event(self, state, at, value, ordinal=0):
        planned, signature, done, _ = state or (None, None, False, at)
        done = done or bool(value[1])
        hit = not done and (planned is None or value[0] != signature or at - planned >= self.recheck_ms)
        return (at if hit else planned, value[0], done, at), [(at, ordinal, value[0])] if hit else []

    def due(self, state):
        return state[3] + self.forget_ms


@dataclass(frozen=True)
class TtlLedger(Machine):
    """Sightings to examine: new keys, changed signatures, and those examined ``ttl_ms`` ago with attempts left.

    A key not examined for ``keep_ms`` is forgotten.
    """

    ttl_ms: int
    max_attempts: int
    keep_ms: int = 60 * DAY_MS
    value, state, out = "signature string", "signature string, examined long, attempts int", "ms long, signature string, why string, attempts int"

    def event(self, state, at, value):
        signature, examined, attempts = state or (None, None, 0)
        if state is None or signature != value[0]:
            return (value[0], at, 1), [(at, value[0], "new" if state is None else "changed", 1)]
        if at - examined >= self.ttl_ms and attempts < self.max_attempts:
            return (signature, at, attempts + 1), [(at, signature, "expired", attempts + 1)]
        return state, []

    def due(self, state):
        return state[1] + self.keep_ms


@dataclass(frozen=True)
class CompleteOnce(Machine):
    """The first completion of a key; forgotten ``forget_ms`` after it was last seen complete."""

    forget_ms: int = 60 * DAY_MS
    value, state, out = "complete boolean", "seen long", "ms long"

    def event(self, state, at, value):
        return ((at,), [] if state else [(at,)]) if value[0] else (state, [])

    def due(self, state):
        return state[0] + self.forget_ms


@dataclass(frozen=True)
class ChangeGate(Machine):
    """Sightings whose signature differs from the one judged last; a key not seen for ``forget_ms`` is judged anew."""

    forget_ms: int = 60 * DAY_MS
    value, state, out = "signature string", "signature string, seen long", "ms long, signature string"

    def event(self, state, at, value):
        changed = state is None or state[0] != value[0]
        return (value[0], at), [(at, value[0])] if changed else []

    def due(self, state):
        return state[1] + self.forget_ms


def columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(",")]


class InEventTime(StatefulProcessor):
    """Runs a machine: what waits for the watermark, the state, and one timer are all that a key keeps.

    They are one value, read once and written only where it changed, and the
    timer is moved only where its time did: every call to the state store is a
    message to another process, and those are what a key costs.
    """

    def __init__(self, machine: Machine) -> None:
        self.machine = machine
        self.with_ordinal = isinstance(machine, Throttle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        waiting = ",".join(f"{name}:{kind}" for name, kind in (c.split() for c in f"at long, ord long, {self.machine.value}".split(",")))
        state = ",".join(f"{name}:{kind}" for name, kind in (c.split() for c in self.machine.state.split(",")))
        self.kept = handle.getValueState("kept", f"state struct<{state}>, waiting array<struct<{waiting}>>, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # rows of the clock have no ordinal: they only carry time on
        return self._advance(key, [tuple(r)[1:-1] for r in rows if r["ord"] is not None], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: Any, new: list[tuple], watermark: int) -> Iterator[Row]:
        m, out, i = self.machine, [], 0
        order = lambda r: (r[0], r[1], str(r[2:]))
        was = self.kept.get()
        state, before, timer = was or (None, (), None)
        state = None if state is None else tuple(state)
        events = sorted([*map(tuple, before), *new], key=order)
        while True:
            due = m.due(state) if state is not None else None
            event = events[i] if i < len(events) and events[i][0] < watermark else None
            if event is not None and (due is None or event[0] <= due):
                more = {"ordinal": event[1]} if self.with_ordinal else {}
                state, rows = m.event(state, event[0], event[2:], **more)
                i += 1
            elif due is not None and due < watermark:
                state, rows = m.expired(state, due)
            else:
                break
            out += rows
        self._keep(was, events[i:], state, timer)
        names = ("key", *columns(m.out))
        return iter([Row(**dict(zip(names, (key[0], *r)))) for r in out])

    def _keep(self, was: tuple | None, events: list[tuple], state: tuple | None, timer: int | None) -> None:
        nexts = [e[0] for e in events[:1]] + [d for d in [self.machine.due(state) if state is not None else None] if d is not None]
        wanted = min(nexts) + 1 if nexts else None
        now = (state, events, wanted)
        if events or state is not None:
            if now != was:
                self.kept.update(now)
        elif was is not None:
            self.kept.clear()
        if timer != wanted:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)

    def close(self) -> None:
        pass


def in_event_time(stream: DataFrame, machine: Machine, *, key: str, at: str, ordinal: str, values: tuple[str, ...], delay: str) -> DataFrame:
    """What a machine tells of each key of a stream: ``key`` and the machine's ``out``.

    ``at`` is a timestamp; events up to ``delay`` behind the latest are waited
    for, later ones are dropped.  A row whose ordinal is null only carries the
    time on (the tick of a clock).  Needs the RocksDB state store.
    """
    names = columns(machine.value)
    spread = stream.withWatermark(at, delay).select(
        F.col(key).alias("key"), F.unix_millis(at).alias("at"), F.col(ordinal).cast("long").alias("ord"), *(F.col(v).alias(n) for v, n in zip(values, names)), F.col(at).alias("_event_time"))
    kind = spread.schema["key"].dataType.simpleString()
    rows = spread.groupBy("key")
    return rows.transformWithState(InEventTime(machine), f"key {kind}, {machine.out}", "append", "EventTime")
