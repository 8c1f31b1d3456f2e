"""Aggregations: completeness, coverage, plans, hierarchies and signatures.

Counts and sums use partial aggregation before the shuffle.  Lists are only
collected where their size is bounded by the group itself (the tracks of one
album) or by a top-k taken first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import fixed
from ledgerline.functions.keys import path_parts
from ledgerline.functions.predicates import ancestors, is_audio_file
from ledgerline.functions.similarity import sim_title, sim_title_native
from ledgerline.functions.text import col, text_or_empty
from ledgerline.operators.common import best_row, numbered, spread, top_per_group
from ledgerline.operators.joins import join_title_close


def tag_plan(tracks: DataFrame, *, album_id: str = "album_id") -> DataFrame:
    """Tag rows with album-level defaults and the album's track total.

    The total comes from an aggregate joined back, not from a window, so a hot
    album is counted map-side.
    """
    totals = tracks.groupBy(album_id).agg(F.count("*").cast("string").alias("tracktotal"))
    title = F.coalesce(F.nullif(text_or_empty("title"), F.lit("")), F.format_string("Track %02d", F.col("number")))
    return tracks.join(totals, album_id).select(
        album_id, "track_id", F.col("number").cast("string").alias("tracknumber"), "tracktotal", title.alias("title"),
        F.coalesce(F.nullif(text_or_empty("performer"), F.lit("")), F.col("album_performer")).alias("artist"),
        F.col("album_performer").alias("albumartist"), "album", "date")


def key_collision_audit(df: DataFrame, *, name: str, key: Column) -> DataFrame:
    """Every name of a key that several names share or that is empty, a row each, with their number."""
    pairs = df.select(key.alias("key"), F.col(name).alias("name")).distinct()
    shared = pairs.groupBy("key").agg(F.count("*").alias("n_names")).filter((F.col("n_names") > 1) | (F.col("key") == ""))
    return pairs.join(shared, "key")


def is_complete(have, total) -> Column:
    h, t = F.coalesce(col(have), F.lit(0)), F.coalesce(col(total), F.lit(0))
    return (h > 0) & (t > 0) & (h >= t)


def agg_completeness(albums: DataFrame, tracks: DataFrame) -> DataFrame:
    """Complete by the album's own counts, else by its monitored tracks."""
    t = tracks.filter(F.coalesce("track_monitored", F.lit(True))).groupBy("album_id").agg(
        F.count("*").alias("t_total"), F.count_if(F.col("has_file")).alias("t_have"))
    out = albums.join(t, "album_id", "left")
    by_stats, by_tracks = is_complete("have", "total"), is_complete("t_have", "t_total")
    big = lambda a, b: F.greatest(F.coalesce(F.col(a), F.lit(0)), F.coalesce(F.col(b), F.lit(0)))
    pick = lambda a, b: F.when(by_stats, F.col(a)).when(by_tracks, F.col(b)).otherwise(big(a, b))
    return out.select("album_id", (by_stats | by_tracks).alias("complete"),
                      pick("have", "t_have").alias("have"), pick("total", "t_total").alias("total"))


def agg_wanted_missing(albums: DataFrame) -> DataFrame:
    return albums.filter(F.col("monitored") & (F.coalesce("have", F.lit(0)) < F.coalesce("total", F.lit(0)))) \
        .withColumn("n_missing", F.col("total") - F.coalesce("have", F.lit(0)))


def agg_coverage_rank(carried: DataFrame, *, exclude: DataFrame | None = None) -> DataFrame:
    """Releases by the number of distinct wanted tracks they carry.

    Carried rows need ``release_key, title, track, date, ordinal``.  The
    shortest title stands for a release, then the lowest ordinal.  Ranked by
    coverage, older date, key; a missing date counts as the latest.
    """
    rows = carried.filter(text_or_empty("release_key") != "")
    if exclude is not None:
        rows = rows.join(exclude.select("release_key").distinct(), "release_key", "left_anti")
    face = rows.groupBy("release_key").agg(
        best_row(["title", "date"], [F.length("title"), F.col("ordinal")]).alias("f"))
    cover = rows.select("release_key", "track").distinct().groupBy("release_key").agg(F.count("*").alias("coverage"))
    return (cover.join(face, "release_key")
            .select("release_key", "coverage", F.col("f.title").alias("title"), F.col("f.date").alias("date"))
            .orderBy(F.col("coverage").desc(), F.coalesce(F.nullif("date", F.lit("")), F.lit("9999")), "release_key"))


# --- assembly plans -------------------------------------------------------------------
def artist_evidence(pairs: DataFrame, *, fuzzy: bool = True) -> DataFrame:
    """Keep pairs whose artist evidence allows them; adds ``bonus``.

    Strong evidence (the song's own credits) may confirm or reject, weak
    evidence (its folders) may only confirm; none at all leaves the decision to
    the title.  Albums by various artists accept anything; an album without an
    artist accepts nothing.  Needs ``want_artist, various, strong, weak``.
    """
    score = (lambda a, b: sim_title_native(a, b))
    agree = lambda names: F.exists(names, lambda a: F.coalesce(score(a, F.col("want_artist")), F.lit(0.0)) >= fixed.ARTIST_AGREE_MIN)
    named = text_or_empty("want_artist") != ""
    out = pairs.withColumn("_ok", agree(F.col("strong")) | agree(F.col("weak")))
    if fuzzy:
        # spelling variants are rare: score distinct artist pairs only
        names = F.array_distinct(F.concat("strong", "weak"))
        open_pairs = out.filter(~F.col("_ok") & named & ~F.col("various")).select("want_artist", F.explode(names).alias("_a")).distinct()
        la, lb = F.length("want_artist"), F.length("_a")
        close = (open_pairs.filter(F.lit(2.0) * F.least(la, lb) >= F.lit(fixed.ARTIST_AGREE_MIN) * (la + lb))
                 .withColumn("_s", sim_title("_a", "want_artist")).filter(F.col("_s") >= fixed.ARTIST_AGREE_MIN)
                 .groupBy("want_artist").agg(F.collect_set("_a").alias("_close")))
        out = out.join(close, "want_artist", "left").withColumn(
            "_ok", F.col("_ok") | F.coalesce(F.arrays_overlap(names, "_close"), F.lit(False))).drop("_close")
    allowed = F.col("various") | (named & (F.col("_ok") | (F.size("strong") == 0)))
    bonus = F.when(~F.col("various") & F.col("_ok"), fixed.ARTIST_BONUS).otherwise(0.0)
    return out.filter(allowed).withColumn("bonus", bonus).drop("_ok")


def best_sources(wants: DataFrame, sources: DataFrame, *, fuzzy: bool = True,
                 minimum: float = fixed.PLAN_MIN_SCORE) -> DataFrame:
    """Best source for every wanted track that has none.

    Wants need ``track_id, title_key, want_artist, various``; sources need
    ``ordinal, path, titles (array), strong, weak``.  Titles are scored as
    distinct pairs.  Sources are first reduced to one row per (title, strong,
    weak): the lowest ordinal, which is the one that would win a tie anyway, so
    copies of a hot title do not multiply the pairs.
    """
    s = (sources.select("ordinal", "path", "strong", "weak", F.explode(F.array_distinct("titles")).alias("cand"))
         .filter("cand <> ''").groupBy("cand", "strong", "weak").agg(best_row(["ordinal", "path"], [F.col("ordinal")]).alias("s")))
    w = wants.filter("title_key <> ''")
    asks = w.select("title_key", "want_artist", "various").distinct()
    low = minimum - fixed.ARTIST_BONUS
    pairs = join_title_close(asks, s.withColumnRenamed("cand", "title_key"), floor=low)
    if fuzzy:
        scored = spread(pairs, "want", "cand").withColumn("score", sim_title("want", "cand"))
    else:
        scored = pairs.withColumn("score", sim_title_native("want", "cand"))
    scored = scored.filter(F.col("score") >= low)
    judged = artist_evidence(
        asks.join(scored.select(F.col("want").alias("title_key"), "cand", "score"), "title_key").join(s, "cand"), fuzzy=fuzzy)
    total = F.col("score") + F.col("bonus")
    best = (judged.withColumn("total", total)
            .groupBy("title_key", "want_artist", "various")
            .agg(best_row(["total", "s"], [-F.least(F.col("total"), F.lit(1.0)), F.col("s.ordinal")]).alias("b")))
    return (w.join(best, ["title_key", "want_artist", "various"], "left")
            .select(*w.columns, F.col("b.total").alias("total"), F.col("b.s.path").alias("source"), F.col("b.s.ordinal").alias("source_ordinal")))


def agg_plan_album(tracks: DataFrame, sources: DataFrame, *, fuzzy: bool = True,
                   minimum: float = fixed.PLAN_MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """(track rows with a state, album rows with counts and pct).

    Tracks need ``album_id, track_id, title_key, want_artist, various,
    has_file``.  A track is present, matched (score at least ``minimum``) or
    missing; pct counts present tracks too.
    """
    t = tracks.filter("title_key <> ''")
    open_ = best_sources(t.filter(~F.col("has_file")), sources, fuzzy=fuzzy, minimum=minimum)
    hit = F.coalesce(F.col("total") >= minimum, F.lit(False))
    rows = open_.select("album_id", "track_id", F.when(hit, "matched").otherwise("missing").alias("state"),
                        F.round(F.least(F.col("total"), F.lit(1.0)), 3).alias("score"), F.when(hit, F.col("source")).alias("source"))
    rows = rows.unionByName(t.filter("has_file").select(
        "album_id", "track_id", F.lit("present").alias("state"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("source")))
    return rows, plan_totals(rows)


def plan_totals(rows: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s)
    return (rows.groupBy("album_id").agg(n("matched").alias("n_matched"), n("present").alias("n_present"),
                                         n("missing").alias("n_missing"), F.count("*").alias("total"))
            .withColumn("pct", F.bround(F.lit(100.0) * (F.col("n_matched") + F.col("n_present")) / F.col("total"), 1)))


def agg_plan_refresh(rows: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn matched rows whose source vanished into missing ones and recount."""
    there = live.select(F.col("path").alias("source")).distinct().withColumn("_live", F.lit(True))
    out = rows.join(there, "source", "left")
    lost = (F.col("state") == "matched") & F.col("_live").isNull()
    out = out.withColumn("state", F.when(lost, "missing").otherwise(F.col("state"))) \
        .withColumn("source", F.when(~lost, F.col("source"))).drop("_live")
    return out, plan_totals(out)


def agg_needed_files(matched: DataFrame) -> DataFrame:
    """Every album a source file feeds, a row each, with their number."""
    pairs = matched.filter(F.col("source").isNotNull()).select("source", "album_id").distinct()
    return pairs.join(pairs.groupBy("source").agg(F.count("*").alias("n_albums")), "source")


def agg_bundle_plan(files: DataFrame) -> DataFrame:
    """Per album folder of a bundle: audio files, all files, bytes.

    Files need ``hash, album_dir, path, size``; folders without audio drop out.
    """
    return (files.groupBy("hash", "album_dir")
            .agg(F.count_if(is_audio_file("path")).alias("n_audio"), F.count("*").alias("n_files"), F.sum("size").alias("size"))
            .filter("n_audio > 0"))


def agg_match_summary(judged: DataFrame) -> DataFrame:
    """One row: scanned, matched, albums, rejected, untagged."""
    hit = F.col("want_ordinal").isNotNull()
    return judged.agg(
        F.count("*").alias("scanned"), F.count_if(hit).alias("matched"), F.count_distinct(F.when(hit, F.col("album"))).alias("albums"),
        F.count_if(~hit).alias("rejected"), F.count_if(F.col("reason") == "no title tag").alias("untagged"))


def agg_match_rejects(judged: DataFrame) -> DataFrame:
    """Rows without a match and why, but for the common reason that no album wants the title."""
    return judged.filter(F.col("want_ordinal").isNull() & (F.col("reason") != "title not wanted by any album")).select("ordinal", "reason")


def agg_match_report(judged: DataFrame) -> DataFrame:
    """Matched rows with their rank in the album, closest first, and the album's match count.  A report prints the first ranks."""
    hits = judged.filter(F.col("want_ordinal").isNotNull())
    album = Window.partitionBy("album")
    return hits.withColumns({"n_matched": F.count("*").over(album), "rank": F.row_number().over(album.orderBy("delta_ms", "ordinal"))})


def agg_full_album_gate(candidates: DataFrame, totals: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Candidate rows of albums whose every track the source supplies.

    Rejected rows and rows with a missing id drop out before counting.
    """
    rows = candidates.filter((F.coalesce("n_rejections", F.lit(0)) == 0) & (text_or_empty("path") != "")
                             & F.col("album_id").isNotNull() & F.col("track_id").isNotNull() & F.col("release_id").isNotNull())
    if allowed is not None:
        rows = rows.join(allowed.select("album_id").distinct(), "album_id", "left_semi")
    supplied = rows.select("album_id", "track_id").distinct().groupBy("album_id").agg(F.count("*").alias("n_supplied"))
    ok = supplied.join(totals.select("album_id", "total"), "album_id", "left").filter(
        (F.coalesce("total", F.lit(0)) <= 0) | (F.col("n_supplied") == F.col("total"))).select("album_id", "n_supplied")
    return rows.join(ok, "album_id")


def agg_majority(df: DataFrame, *, group: str, value: str, ordinal: str) -> DataFrame:
    """Most common non-empty value per group; the first seen wins a tie."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("_n"), F.min(ordinal).alias("_first"))
    named = text_or_empty(value) != ""
    return counts.groupBy(group).agg(
        F.min_by(F.when(named, F.col(value)), F.when(named, F.struct(-F.col("_n"), "_first"))).alias(value),
        F.coalesce(F.sum(F.when(named, F.col("_n"))), F.lit(0)).alias("n_identified"), F.sum("_n").alias("n_total"))


def agg_signature(df: DataFrame, *, group: str, size: str, modified: str) -> DataFrame:
    """Content signature "count:sum:newest" per group."""
    return df.groupBy(group).agg(F.concat_ws(
        ":", F.count("*").cast("string"), F.sum(size).cast("string"), F.floor(F.max(modified)).cast("string")).alias("signature"))


def agg_set_signature(df: DataFrame, *, group: Iterable[str], item: str) -> DataFrame:
    """Signature of a set of ids that does not depend on row order.

    Two independent 64-bit sums of hashes stand in for a hash of the sorted
    list, so no group is ever collected.
    """
    ids = df.select(*group, item).distinct()
    wrap = lambda h: F.pmod(F.sum(F.pmod(h, F.lit(2 ** 31)).cast("bigint")), F.lit(2 ** 61)).cast("string")
    return ids.groupBy(*group).agg(F.concat_ws(
        ":", F.count("*").cast("string"), wrap(F.xxhash64(F.lit(1), item)), wrap(F.xxhash64(F.lit(2), item))).alias("signature"))


# --- hierarchies -----------------------------------------------------------------------------
def _dirs_of(path) -> Column:
    """The root "" and every ancestor folder."""
    return F.array_prepend(ancestors(path), F.lit(""))


def agg_dir_rollup(files: DataFrame, *, path: str = "path", size: str = "size") -> DataFrame:
    """Bytes and files rolled into every ancestor folder.

    Files are first summed per own folder, so the explode runs over folders,
    and partial sums keep the root from collecting rows.
    """
    parts = path_parts(path)
    own = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    leaf = files.groupBy(own.alias("own")).agg(F.sum(size).alias("size"), F.count("*").alias("n_files"))
    up = F.when(F.col("own") == "", F.array(F.lit(""))).otherwise(F.array_append(_dirs_of("own"), F.col("own")))
    return leaf.select(F.explode(up).alias("dir"), "size", "n_files").groupBy("dir").agg(F.sum("size").alias("size"), F.sum("n_files").alias("n_files"))


def agg_dir_delta(dirs: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply per-folder changes (``dir, d_size, d_files``) to all ancestors, floor 0."""
    up = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.array_append(_dirs_of("dir"), F.col("dir")))
    delta = (changes.groupBy("dir").agg(F.sum("d_size").alias("d_size"), F.sum("d_files").alias("d_files"))
             .select(F.explode(up).alias("dir"), "d_size", "d_files")
             .groupBy("dir").agg(F.sum("d_size").alias("d_size"), F.sum("d_files").alias("d_files")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = dirs.join(delta, "dir", "full_outer").select(
        "dir", F.greatest(zero("size") + zero("d_size"), F.lit(0)).alias("size"),
        F.greatest(zero("n_files") + zero("d_files"), F.lit(0)).alias("n_files"))
    return out.filter((F.col("n_files") > 0) | (F.col("dir") == ""))


def parent_dir(path) -> Column:
    parts = path_parts(path)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def agg_dir_listing(dirs: DataFrame, files: DataFrame, parent: str | None = None) -> DataFrame:
    """Children of a folder: folders with rolled-up totals, then files.

    Without ``parent`` every folder is listed (one row per child).
    """
    d = dirs.filter("dir <> ''").select(parent_dir("dir").alias("parent"), F.col("dir").alias("name"), F.lit("folder").alias("kind"), "size", "n_files")
    f = files.select(parent_dir("path").alias("parent"), F.col("path").alias("name"), F.lit("file").alias("kind"), "size", F.lit(1).cast("bigint").alias("n_files"))
    out = d.unionByName(f)
    return out if parent is None else out.filter(F.col("parent") == parent)


# --- progress and reports ------------------------------------------------------------------------
def agg_job_progress(jobs: DataFrame) -> DataFrame:
    """Per folder and overall: totals per state and pct (running counts its share).

    Folders have their ``rank``: those at work first, then the least finished.
    """
    share = F.when(F.col("state") == "running", F.coalesce("pct", F.lit(0.0)) / 100).when(F.col("state") == "queued", 0.0).otherwise(1.0)
    rolled = jobs.withColumn("_s", share).rollup("dir").agg(
        F.grouping("dir").alias("overall"), F.count("*").alias("total"),
        F.count_if(~F.col("state").isin("running", "queued")).alias("done"), F.count_if(F.col("state") == "running").alias("running"),
        F.count_if(F.col("state") == "queued").alias("queued"), F.sum("_s").alias("_p"))
    out = rolled.withColumn("pct", F.bround(F.lit(100.0) * F.round("_p", 9) / F.col("total"), 1)).drop("_p")
    ranked = numbered(out.filter("overall = 0"), F.col("running").desc(), F.col("pct").asc(), F.col("dir").asc())
    return ranked.unionByName(out.filter("overall = 1"), allowMissingColumns=True)


def job_window(jobs: DataFrame) -> DataFrame:
    """Jobs in the order of a status page, with their place in it: running and queued ones by age, finished ones newest first.

    A page shows everything running and the first places of both kinds.
    """
    active = F.col("state").isin("running", "queued")
    kind = F.when(F.col("state") == "running", 0).when(F.col("state") == "queued", 1).otherwise(2)
    age = F.when(active, F.col("added")), F.col("added").desc(), F.when(active, F.col("job_id")), F.col("job_id").desc()
    rows = jobs.withColumn("active", active)
    places = numbered(rows, F.col("active").desc(), kind.asc(), age[0].asc(), age[1], age[2].asc(), age[3], out="_n")
    n_active = jobs.filter(active).agg(F.count("*").alias("n")).scalar()
    return places.withColumn("place", F.col("_n") - F.when(F.col("active"), 0).otherwise(n_active)).drop("_n")


def agg_badges(plans: DataFrame) -> DataFrame:
    return plans.agg(F.count("*").alias("n"), F.count_if(F.col("pct") >= 100).alias("complete"), F.count_if(F.col("hunting")).alias("hunting"))


def agg_audio_majority(files: DataFrame) -> DataFrame:
    """Bundles without a category that are mostly audio."""
    return (files.filter(F.trim(text_or_empty("category")) == "").groupBy("hash")
            .agg(F.count_if(is_audio_file("path")).alias("n_audio"), F.count("*").alias("n_files"))
            .filter((F.col("n_audio") > 0) & (F.col("n_audio") * 2 >= F.col("n_files"))))


def agg_title_coverage(release_titles: DataFrame, album_titles: DataFrame) -> DataFrame:
    """Share of an album's titles each release lists; the best release decides."""
    a = album_titles.select("album_id", "title_key").distinct()
    n = a.groupBy("album_id").agg(F.count("*").alias("n"))
    hits = (release_titles.select("release_id", "album_id", "title_key").distinct()
            .join(a, ["album_id", "title_key"]).groupBy("album_id", "release_id").agg(F.count("*").alias("hit")))
    best = hits.groupBy("album_id").agg(best_row(["release_id", "hit"], [-F.col("hit"), F.col("release_id")]).alias("b"))
    ratio = F.coalesce(F.col("b.hit"), F.lit(0)) / F.col("n")
    return n.join(best, "album_id", "left").select(
        "album_id", F.col("b.release_id").alias("release_id"), F.round(ratio, 6).alias("coverage"),
        F.when(ratio >= fixed.COVERAGE_ACCEPT, "accept").when(ratio < fixed.COVERAGE_REJECT, "reject").otherwise("unsure").alias("verdict"))


def human_size(n) -> Column:
    """Bytes in the largest fitting unit with one decimal."""
    x = col(n).cast("double")
    out = F.format_string("%.1f PB", x / 1024 ** 5)
    for i, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(x < 1024 ** (i + 1), F.format_string(f"%.1f {unit}", x / 1024 ** i)).otherwise(out)
    return out


def agg_category_totals(rows: DataFrame, *, category: str = "category", size: str = "size") -> DataFrame:
    """Rows and bytes per category and overall, largest first."""
    agg = rows.rollup(category).agg(F.grouping(category).alias("overall"), F.count("*").alias("n"), F.sum(size).alias("bytes"))
    return agg.withColumn("shown", human_size("bytes")).orderBy(F.col("bytes").desc(), category)


def agg_format_profile(files: DataFrame) -> DataFrame:
    """Audio profile of a folder; files need ``dir, format, lossless, channels, bits, rate, size``.

    Formats are counted per (folder, format) first, so the map holds one entry
    per format whatever the number of files.
    """
    per = files.groupBy("dir", "format").agg(
        F.count("*").alias("n"), F.count_if(F.col("lossless")).alias("nl"), F.max("channels").alias("ch"),
        F.max("bits").alias("bits"), F.max("rate").alias("rate"), F.sum("size").alias("size"))
    return per.groupBy("dir").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("format", "n")))).alias("formats"),
        F.sum("n").alias("n_files"), (F.sum("nl") == F.sum("n")).alias("lossless"), (F.sum("nl") < F.sum("n")).alias("has_lossy"),
        (F.max("ch") > 2).alias("multichannel"), F.max("ch").alias("max_channels"), F.max("bits").alias("max_bits"),
        F.max("rate").alias("max_rate"), F.sum("size").alias("bytes"))
