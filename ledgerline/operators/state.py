"""Keyed state in batch form: gates, ledgers, upserts and timers.

``now`` is always an argument.  The streaming twins live in
``ledgerline.streaming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import fixed
from ledgerline.functions.keys import key_entry_id
from ledgerline.functions.text import text_or_empty
from ledgerline.operators.common import cut, with_neighbours

BUCKET_S = 86_400


def st_change_gate(current: DataFrame, ledger: DataFrame, *, key: str = "key", signature: str = "signature") -> DataFrame:
    """Rows whose signature differs from the one last judged."""
    return current.join(ledger.select(key, signature), [key, signature], "left_anti")


def st_change_mark(ledger: DataFrame, judged: DataFrame, *, key: str = "key") -> DataFrame:
    """The ledger after judging: new signatures replace old ones."""
    return ledger.join(judged.select(key), key, "left_anti").unionByName(judged.select(*ledger.columns))


def st_ttl_ledger(current: DataFrame, ledger: DataFrame, *, now: int, ttl_s: int, max_attempts: int) -> DataFrame:
    """Rows to examine again: new, changed, or expired with attempts left."""
    old = ledger.select("key", F.col("signature").alias("_s"), F.col("ts").alias("_ts"), F.col("attempts").alias("_n"))
    out = current.join(old, "key", "left")
    why = (F.when(F.col("_ts").isNull(), "new").when(F.col("_s") != F.col("signature"), "changed")
           .when((F.lit(now) - F.col("_ts") >= ttl_s) & (F.col("_n") < max_attempts), "expired"))
    return out.withColumn("why", why).filter("why IS NOT NULL").drop("_s", "_ts", "_n")


def st_ledger_prune(ledger: DataFrame, *, now: int, keep_s: int = 30 * 86400) -> DataFrame:
    return ledger.filter(F.lit(now) - F.col("ts") <= keep_s)


def st_recheck_gap(events: DataFrame, *, key: str, ts: str, gap_s: int, ordinal: str | None = None) -> DataFrame:
    """Events at least ``gap_s`` after the previous one of their key."""
    near = with_neighbours(events, key=key, ts=ts, bucket=BUCKET_S, ordinal=ordinal)
    return near.filter(F.col("prev").isNull() | (F.col(ts) - F.col("prev") >= gap_s)).drop("prev", "next")


def _marked(sightings: DataFrame, *, key: str, ts: str, signature: str, order: Column, gap: int) -> DataFrame:
    """Sightings with ``_o`` (their place), ``_changed`` and ``_change`` (the place of the next change after them).

    Windows run per key and stretch of ``gap``; only what the stretches end and
    begin with crosses them.
    """
    rows = sightings.withColumn("_o", order).withColumn("_b", F.floor(F.col(ts) / gap))
    ends = rows.groupBy(key, "_b").agg(F.max_by(signature, "_o").alias("_end"))
    per_key = Window.partitionBy(key).orderBy("_b")
    before = ends.select(key, "_b", F.lag(F.struct(F.col("_end").alias("s"))).over(per_key).alias("_last"))
    here = Window.partitionBy(key, "_b").orderBy("_o")
    last = F.coalesce(F.lag(F.struct(F.col(signature).alias("s"))).over(here), F.col("_last"))
    changed = rows.join(before, [key, "_b"]).withColumn("_was", last).withColumn("_changed", F.col("_was").isNull() | ~F.col("_was.s").eqNullSafe(F.col(signature)))
    place = F.when(F.col("_changed"), F.col("_o"))
    firsts = changed.groupBy(key, "_b").agg(F.min(place).alias("_first"))
    later = firsts.select(key, "_b", F.min("_first").over(per_key.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    following = F.min(place).over(here.rowsBetween(1, Window.unboundedFollowing))
    return changed.join(later, [key, "_b"]).withColumn("_change", F.coalesce(following, F.col("_later"))).drop("_last", "_was", "_later")


def _first_after(rows: DataFrame, *, key: str, ts: str, gap: int) -> DataFrame:
    """``key, ts, _next``: for each time the place of the first row at least ``gap`` later.

    Times and times plus ``gap`` meet in stretches of ``gap``: such a stretch
    holds at most ``gap`` times of a key, whatever the number of rows.
    """
    times = rows.groupBy(key, ts).agg(F.min("_o").alias("_place"))
    there = times.select(key, F.col(ts).alias("_t"), "_place", F.lit(None).cast(times.schema[ts].dataType).alias("_from"))
    asked = times.select(key, (F.col(ts) + gap).alias("_t"), F.lit(None).cast(times.schema["_place"].dataType).alias("_place"), F.col(ts).alias("_from"))
    both = there.unionByName(asked).withColumn("_b", F.floor(F.col("_t") / gap))
    here = Window.partitionBy(key, "_b").orderBy(F.col("_t").desc(), F.col("_from").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_key = Window.partitionBy(key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    later = both.groupBy(key, "_b").agg(F.min("_place").alias("_p")).select(key, "_b", F.min("_p").over(per_key).alias("_later"))
    found = both.withColumn("_in", F.min("_place").over(here)).filter("_from IS NOT NULL").join(later, [key, "_b"])
    return found.select(key, F.col("_from").alias(ts), F.coalesce("_in", "_later").alias("_next"))


def st_recheck_throttle(sightings: DataFrame, *, key: str, ts: str, signature: str, done: str, recheck_s: int, ordinal: str | None = None) -> DataFrame:
    """Which sightings of a key get planned.

    First sight, a changed signature, or ``recheck_s`` since the last *planned*
    sighting; never after completion.  Ties go by ``ordinal``; sightings that
    agree in both must agree in all.

    Every sighting points to the first one ``recheck_s`` later, unless the
    signature changes before.  Those planned are what first sights and changes
    reach: pointers are doubled, and each round marks what the marked ones point
    to, so there are as many rounds as the longest chain's length has bits.  No
    task sees all rows of a key.
    """
    gap = max(int(recheck_s), 1)
    order = F.struct(F.col(ts).alias("t"), (F.col(ordinal) if ordinal else F.lit(0)).alias("o"))
    ended = sightings.filter(done).groupBy(key).agg(F.min(order).alias("_end"))
    alive = sightings.join(ended, key, "left").filter(F.col("_end").isNull() | (order < F.col("_end"))).drop("_end")
    rows = cut(_marked(alive, key=key, ts=ts, signature=signature, order=order, gap=gap))
    ahead = _first_after(rows, key=key, ts=ts, gap=gap)
    to = F.when(F.col("_change").isNull() | (F.col("_next") < F.col("_change")), F.col("_next"))
    hops = cut(rows.join(ahead, [key, ts]).select(F.col(key).alias("_k"), F.col("_o").alias("_a"), to.alias("_to")).filter("_to IS NOT NULL").distinct())
    planned = rows.filter("_changed").select(F.col(key).alias("_k"), F.col("_o").alias("_a")).distinct()
    while not hops.isEmpty():
        reached = planned.join(hops, ["_k", "_a"]).select("_k", F.col("_to").alias("_a"))
        planned = cut(planned.unionByName(reached).distinct())
        then = hops.select("_k", F.col("_a").alias("_to"), F.col("_to").alias("_then"))
        hops = cut(hops.join(then, ["_k", "_to"]).select("_k", "_a", F.col("_then").alias("_to")))
    out = rows.join(planned, (F.col(key) == F.col("_k")) & (F.col("_o") == F.col("_a")), "left_semi")
    return out.select(*sightings.columns)


def st_upsert_held(updates: DataFrame, *, path: str = "source_path", fields: tuple[str, ...] = ("artist", "album", "reason", "outcome", "kind"),
                   ts: str = "ts", ordinal: str = "ordinal") -> DataFrame:
    """Fold updates per path: newest non-empty value per column, first and last
    time, number of sightings.  One aggregate with map-side partials."""
    order = F.struct(ts, ordinal)
    filled = lambda c: text_or_empty(c) != ""
    # the order is blank too where the value is, so blanks never win
    newest = [F.coalesce(F.max_by(F.when(filled(c), F.col(c)), F.when(filled(c), order)), F.lit("")) for c in fields]
    agg = updates.groupBy(path).agg(
        *[(F.substring(v, 1, fixed.REASON_MAX_CHARS) if c == "reason" else v).alias(c) for c, v in zip(fields, newest)],
        F.min(ts).alias("created"), F.max(ts).alias("updated"), F.count("*").alias("seen_count"))
    return agg.withColumn("id", key_entry_id(path))


def st_held_fold(updates: DataFrame, *, path: str = "source_path", fields: tuple[str, ...] = ("artist", "album", "reason", "outcome", "kind"),
                 details: str | None = None, ts: str = "ts", ordinal: str = "ordinal") -> DataFrame:
    """What updates come to per path, in a form that merges in any order.

    Each field is ``(ts, ordinal, value)`` of its newest non-empty value,
    ``details`` a map of such, one for each key of a JSON object (variant).
    """
    filled = lambda c: text_or_empty(c) != ""
    newest = [F.max(F.when(filled(c), F.struct(F.col(ts).alias("ts"), F.col(ordinal).alias("ordinal"), F.col(c).alias("value")))).alias(c) for c in fields]
    out = updates.groupBy(path).agg(*newest, F.min(ts).alias("created"), F.max(ts).alias("updated"), F.count("*").alias("seen_count"))
    if details is None:
        return out
    each = updates.select(path, F.col(ts).alias("ts"), F.col(ordinal).alias("ordinal"), F.explode(F.col(details).cast("map<string,variant>")).alias("key", "value"))
    # variants have no order of their own: the newest is picked by time and ordinal
    by_key = each.groupBy(path, "key").agg(F.max_by(F.struct("ts", "ordinal", "value"), F.struct("ts", "ordinal")).alias("newest"))
    maps = by_key.groupBy(path).agg(F.map_from_entries(F.collect_list(F.struct("key", "newest"))).alias("details"))
    return out.join(maps, path, "left")


def st_held_merge(a: DataFrame, b: DataFrame, *, path: str = "source_path") -> DataFrame:
    """Two folds as one.  Newer values win, times take the least and greatest, counts add up: any order of merges gives the same."""
    new = b.select(path, *[F.col(c).alias(f"_{c}") for c in b.columns if c != path])
    fields = [c for c in a.columns if c not in (path, "created", "updated", "seen_count", "details")]
    newer = lambda x, y: F.when(y.isNull() | (F.struct(x["ts"], x["ordinal"]) >= F.struct(y["ts"], y["ordinal"])), F.coalesce(x, y)).otherwise(y)
    maps = [F.when(F.col("_details").isNull(), F.col("details")).when(F.col("details").isNull(), F.col("_details"))
            .otherwise(F.map_zip_with("details", "_details", lambda _, x, y: newer(x, y))).alias("details")] if "details" in a.columns else []
    return a.join(new, path, "full_outer").select(
        path, *[F.greatest(c, f"_{c}").alias(c) for c in fields], F.least("created", "_created").alias("created"), F.greatest("updated", "_updated").alias("updated"),
        (F.coalesce("seen_count", F.lit(0)) + F.coalesce("_seen_count", F.lit(0))).alias("seen_count"), *maps)


def st_held_rows(folded: DataFrame, *, path: str = "source_path") -> DataFrame:
    """The held items that a fold stands for; ``details`` is one variant object again."""
    fields = [c for c in folded.columns if c not in (path, "created", "updated", "seen_count", "details")]
    value = lambda c: F.coalesce(F.col(f"{c}.value"), F.lit(""))
    details = [F.to_variant_object(F.transform_values("details", lambda _, x: x["value"])).alias("details")] if "details" in folded.columns else []
    return folded.select(path, key_entry_id(path).alias("id"), *[(F.substring(value(c), 1, fixed.REASON_MAX_CHARS) if c == "reason" else value(c)).alias(c) for c in fields],
                         "created", "updated", "seen_count", *details)


def st_upsert_plan(stored: DataFrame, new: DataFrame, *, key: str = "id") -> DataFrame:
    """New rows replace stored ones; the first creation time stays."""
    born = stored.select(key, F.col("created").alias("_c"))
    fresh = new.join(born, key, "left").withColumn("created", F.coalesce("_c", "created")).drop("_c")
    return stored.join(new.select(key), key, "left_anti").unionByName(fresh.select(*stored.columns))


def st_first_missing(passes: DataFrame, *, key: str, ts: str, missing: str, now: int, min_days: float) -> DataFrame:
    """Keys missing in their latest pass: since when, and whether long enough.

    The clock starts at the first missing pass after the last one that had the
    item.  Two aggregates, no ordered scan of a key's history.
    """
    is_missing = F.col(missing)
    filled = passes.groupBy(key).agg(F.max(F.when(~is_missing, F.col(ts))).alias("_filled"))
    open_ = (passes.filter(is_missing).join(filled, key)
             .filter(F.col("_filled").isNull() | (F.col(ts) > F.col("_filled")))
             .groupBy(key).agg(F.min(ts).alias("missing_since")))
    return open_.withColumn("eligible", F.lit(now) - F.col("missing_since") >= min_days * 86400)


def st_complete_once(events: DataFrame, *, key: str, ts: str, complete: str) -> DataFrame:
    return events.filter(F.col(complete)).groupBy(key).agg(F.min(ts).alias(ts))


def st_idle_timer(events: DataFrame, *, key: str, ts: str, now: int, grace_s: int) -> DataFrame:
    """Every silence of at least ``grace_s`` after an event, the open one included."""
    near = with_neighbours(events.select(key, ts), key=key, ts=ts, bucket=BUCKET_S)
    return near.select(key, F.col(ts).alias("idle_from"), F.coalesce("next", F.lit(now)).alias("idle_to")).filter(
        F.col("idle_to") - F.col("idle_from") >= grace_s)


def st_dead_timer(events: DataFrame, *, key: str, ts: str, progress: str, now: int, grace_s: int) -> DataFrame:
    """Keys first seen at least ``grace_s`` ago that never made progress."""
    agg = events.groupBy(key).agg(F.min(ts).alias("added"), F.max(progress).alias("best"))
    return agg.filter((F.col("best") < 0.01) & (F.lit(now) - F.col("added") >= grace_s))


def st_detail_cache(listing: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached details still valid, files whose detail must be read again).

    Both need ``path, size, mtime``; vanished files drop out of both.
    """
    on = ["path", "size", "mtime"]
    return cache.join(listing.select(*on), on, "left_semi"), listing.join(cache.select(*on), on, "left_anti")


def st_queue_restore(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: unfinished ones are queued again from zero."""
    live = jobs.filter(F.col("state").isin("queued", "running"))
    return live.withColumn("state", F.lit("queued")).withColumn("pct", F.lit(0.0))


def st_clear_failed_queue(queue: DataFrame) -> DataFrame:
    return queue.filter(F.lower("state").isin("failed", "importfailed"))
