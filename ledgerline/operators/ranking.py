"""Window and ordering operators: picks, margins, budgets, rotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import text_or_empty
from ledgerline.operators.common import best_row, numbered, prefix_sum, top_per_group


def win_best_per_source(pairs: DataFrame, *, source: str = "source", value: str = "delta_ms", ordinal: str = "want_ordinal") -> DataFrame:
    """Closest wanted item per source; the lowest ordinal wins a tie."""
    rest = [c for c in pairs.columns if c != source]
    return pairs.groupBy(source).agg(best_row(rest, [F.abs(value), F.col(ordinal)]).alias("b")).select(source, "b.*")


def win_one_per_track(matches: DataFrame, *, ordinal: str = "ordinal", want: str = "want_ordinal", value: str = "delta_ms") -> DataFrame:
    """One source per wanted item; losers become duplicates, not reassigned.

    The winner comes from an aggregate with a map-side part, so a song whose
    copies make up a third of all rows costs one row per task.
    """
    keep = matches.groupBy(want).agg(F.min_by(ordinal, F.struct(F.abs(value), F.col(ordinal))).alias("kept"))
    return matches.join(keep, want).withColumn("outcome", F.when(F.col(ordinal) == F.col("kept"), "matched").otherwise("duplicate"))


def win_runner_up(scored: DataFrame, *, group: str, score: str, ordinal: str) -> DataFrame:
    """Best score per group with its margin over the second best."""
    top2 = top_per_group(scored, [group], [F.col(score).desc(), F.col(ordinal)], 2)
    s = F.col(score)
    agg = top2.groupBy(group).agg(F.max_by(ordinal, F.struct(s, -F.col(ordinal))).alias(ordinal), F.max(s).alias(score),
                                  F.when(F.count("*") > 1, F.min(s)).alias("runner_up"))
    return agg.withColumn("margin", F.col(score) - F.coalesce("runner_up", F.lit(0.0)))


def win_sheet_end_times(tracks: DataFrame, *, sheet: str = "sheet_id") -> DataFrame:
    """A track ends where the next starts, the last one with the audio."""
    w = Window.partitionBy(sheet).orderBy("position")
    return tracks.withColumn("end_s", F.coalesce(F.lead("start_s").over(w), F.col("duration_s")))


def win_sheet_validity(tracks: DataFrame, sheets: DataFrame, *, sheet: str = "sheet_id") -> DataFrame:
    """Structural validity and the first reason a sheet is not a disc image.

    Tracks need ``sheet_id, position, start_s``; sheets need ``sheet_id, title,
    n_files, has_separator, duration_s``.
    """
    w = Window.partitionBy(sheet).orderBy("position")
    prev = F.coalesce(F.lag("start_s").over(w), F.lit(-1.0))
    seen = tracks.withColumn("_prev", prev)
    agg = seen.groupBy(sheet).agg(
        F.count("*").alias("n_tracks"), F.bool_and(F.col("start_s") >= F.col("_prev")).alias("rising"),
        F.bool_and(F.col("start_s") > F.col("_prev")).alias("strict"), F.max_by("start_s", "position").alias("last_start"))
    out = sheets.join(agg, sheet, "left")
    n = F.coalesce("n_tracks", F.lit(0))
    reason = (F.when(F.col("n_files") == 0, "no file reference").when(F.col("n_files") > 1, "several files")
              .when(F.col("has_separator"), "file in a subfolder").when(n < 2, "too few tracks")
              .when(~F.col("strict"), "starts not increasing")
              .when(F.col("duration_s").isNotNull() & (F.col("last_start") + 1.0 > F.col("duration_s")), "audio too short"))
    return out.select(sheet, ((n > 0) & (text_or_empty("title") != "") & F.coalesce("rising", F.lit(False))).alias("valid"),
                      reason.isNull().alias("disc_image"), reason.alias("reason"))


def win_budget(sources: DataFrame, *, ordinal: str, files: str, budget: int) -> DataFrame:
    """Files taken from each source in order until the budget is spent."""
    out = prefix_sum(sources, order=ordinal, value=files, out="before")
    left = F.greatest(F.lit(budget) - F.col("before"), F.lit(0))
    return out.withColumn("taken", F.least(left, F.col(files)))


def win_rank_candidates(candidates: DataFrame, *, group: str, k: int | None = None, band: float = 0.1, leecher_weight: float = 0.3) -> DataFrame:
    """Candidates of a group with their rank: score band, lossless, swarm; dead last.  With ``k`` only the best."""
    swarm = F.col("seeders") + leecher_weight * F.col("leechers")
    alive = F.when(F.col("seeders") + F.col("leechers") > 0, 1).otherwise(0)
    order = [alive.desc(), F.floor(F.round(F.col("score") / band, 9)).desc(), F.col("lossless").desc(), swarm.desc(), F.col("ordinal")]
    w = Window.partitionBy(group).orderBy(*order)
    ranked = candidates.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def rank_by_seeders(candidates: DataFrame, *, group: str, min_seeders: int = 1, k: int = 0) -> DataFrame:
    """Torrents with enough seeders, most seeders first."""
    live = candidates.filter((F.lower(F.coalesce("protocol", F.lit("torrent"))) == "torrent") & (F.coalesce("seeders", F.lit(0)) >= min_seeders))
    order = [F.col("seeders").desc(), F.col("ordinal")]
    return live if k <= 0 else top_per_group(live, [group], order, k)


def win_rotation(items: DataFrame, *, last: str, ordinal: str, now: int, cooldown: int) -> DataFrame:
    """Items that have cooled down with their turn: never tried first, longest untouched next.  A pass takes as many turns as it can."""
    ready = items.filter(F.col(last).isNull() | (F.lit(now) - F.col(last) >= cooldown))
    return numbered(ready, F.coalesce(last, F.lit(0)).asc(), F.col(ordinal).asc(), out="turn")


def win_newest_first(items: DataFrame, *, arrived: str, ordinal: str) -> DataFrame:
    """Items with their number, newest first."""
    return numbered(items, F.col(arrived).desc_nulls_last(), F.col(ordinal).asc())


#: distinct sizes of a group that one window sorts; larger groups are cut down to a bracket of the median first
MANY = 10_000

#: accuracy of the sketch that places the bracket, and its half width as a share of the group: ten times the sketch's error
SKETCH, HALF = 10_000, 0.001


def upper_median(df: DataFrame, *, group: str, size: str) -> DataFrame:
    """Per group: item count, largest size, and the size at index n/2 descending.

    Sizes are counted per distinct value first, and the running count finds the
    middle; the group is never held as a list.  For a group of more than
    ``MANY`` distinct sizes a quantile sketch bounds the median from both sides
    by more than its error; what lies above is only counted, and the running
    count settles the rank inside the bracket, so no task sorts the group.
    """
    per = df.groupBy(group, size).agg(F.count("*").alias("_c"))
    n = per.groupBy(group).agg(F.sum("_c").alias("n"), F.max(size).alias("largest"), F.count("*").alias("_d"))
    hot = n.filter(F.col("_d") > MANY).select(group)
    ends = F.percentile_approx(size, [0.5 - HALF, 0.5 + HALF], SKETCH)
    bracket = df.join(hot, group, "left_semi").groupBy(group).agg(ends.alias("_e")).select(group, F.get("_e", F.lit(0)).alias("_lo"), F.get("_e", F.lit(1)).alias("_hi"))
    cut_down = per.join(bracket, group, "left").withColumn("_up", F.col("_lo").isNotNull() & (F.col(size) > F.col("_hi")))
    above = cut_down.filter("_up").groupBy(group).agg(F.sum("_c").alias("_above"))
    w = Window.partitionBy(group).orderBy(F.col(size).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cut_down.filter(~F.col("_up") & (F.col("_lo").isNull() | (F.col(size) >= F.col("_lo")))).withColumn("_upto", F.sum("_c").over(w))
    middle = (run.join(n, group).join(above, group, "left")
              .filter(F.col("_upto") + F.coalesce("_above", F.lit(0)) > F.floor(F.col("n") / 2)))
    return middle.groupBy(group).agg(F.max(size).alias("median"), F.first("n").alias("n"), F.first("largest").alias("largest"))


def win_cheap_first(df: DataFrame, *, group: str, size: str, ratio: float = 3.0) -> DataFrame:
    """Folders of evenly sized files first, then by name."""
    m = upper_median(df, group=group, size=size)
    cheap = (F.col("n") >= 2) & (F.col("median") > 0) & (F.col("largest") < ratio * F.col("median"))
    return m.withColumn("cheap", cheap).orderBy(F.col("cheap").desc(), group)


def win_first_by_key(df: DataFrame, *, keys: list[str], ordinal: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(best_row(rest, [F.col(ordinal)]).alias("b")).select(*keys, "b.*")


def win_best_edition(editions: DataFrame, *, group: str, count: str, target: str, ordinal: str) -> DataFrame:
    rest = [c for c in editions.columns if c != group]
    return editions.groupBy(group).agg(best_row(rest, [F.abs(F.col(count) - F.col(target)), F.col(ordinal)]).alias("b")).select(group, "b.*")


def win_sorted_plans(plans: DataFrame) -> DataFrame:
    """Plans with their number, most complete first."""
    return numbered(plans, F.col("pct").desc(), F.col("artist").asc(), F.col("album_id").asc())
