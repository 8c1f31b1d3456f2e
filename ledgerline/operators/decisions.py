"""Decision tables: rows that say what should happen and why.

Each decision is one ordered ``when`` chain over joined facts.  Nothing here
performs an action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import fixed
from ledgerline.functions.predicates import ancestors, is_disc_folder
from ledgerline.functions.similarity import sim_quality_rank
from ledgerline.functions.text import text_or_empty
from ledgerline.operators.common import numbered
from ledgerline.operators.joins import join_ancestor_drop
from ledgerline.operators.rollups import is_complete
from ledgerline.operators.ranking import upper_median

zero = lambda c: F.coalesce(F.col(c), F.lit(0))


def dec_download_class(folders: DataFrame, *, structural: tuple[str, ...] = ()) -> DataFrame:
    """Class of a downloaded folder.

    Needs ``name, n_audio, size, has_video, has_disc_child, complete, total``;
    ``total`` 0 means the catalogue knows nothing of it.
    """
    keep_names = (*fixed.STRUCTURAL_FOLDERS, *structural)
    owned = F.col("complete") & (zero("total") >= F.col("n_audio"))
    music = (F.when(owned & is_disc_folder("name"), "review").when(owned, "dupe")
             .when(zero("total") == 0, "unmatched").otherwise("partial"))
    empty = (F.when(F.lower("name").isin(*keep_names) | F.col("has_disc_child"), "left alone")
             .when(F.col("size") <= fixed.SHELL_MAX_BYTES, "shell").otherwise("left alone"))
    return folders.withColumn("class", F.when(F.col("has_video"), "skipped video")
                              .when(F.col("n_audio") > 0, music).otherwise(empty))


def dec_purgeable(classified: DataFrame, *, now: int, min_stable_s: int = 300) -> DataFrame:
    """Stable duplicates, without those nested under another one."""
    ready = classified.filter((F.col("class") == "dupe") & (F.lit(now) - F.col("newest") >= min_stable_s))
    return join_ancestor_drop(ready)


def dec_deselect(plan: DataFrame) -> DataFrame:
    """Drop or keep an album folder of a bundle.

    Needs ``noise, unofficial, complete, total, n_audio, room`` (the largest
    release that could hold the folder, 0 if none).
    """
    total, tracked_gap = zero("total"), (zero("total") > 0) & ~F.col("complete")
    special = F.col("noise") | F.col("unofficial")
    reason = (F.when(special & tracked_gap, "wanted though unofficial").when(special, "unofficial")
              .when(F.col("complete") & (total >= F.col("n_audio")), "owned")
              .when(F.col("complete") & (zero("room") >= F.col("n_audio")), "bigger edition fits")
              .when(F.col("complete"), "bigger edition fits nowhere")
              .when(total == 0, "not in catalogue").otherwise("incomplete"))
    return plan.withColumn("reason", reason).withColumn("drop", F.col("reason").isin("unofficial", "owned", "bigger edition fits nowhere"))


def dec_useless_bundle(files: DataFrame) -> DataFrame:
    """Bundles with nothing left to want.  Files need ``hash, audio, video, drop``."""
    agg = files.groupBy("hash").agg(F.count_if("audio").alias("n_audio"), F.count_if(F.col("audio") & ~F.col("drop")).alias("n_kept"),
                                    F.count_if("video").alias("n_video"))
    action = (F.when((F.col("n_audio") > 0) & (F.col("n_kept") == 0), "remove")
              .when((F.col("n_audio") == 0) & (F.col("n_video") > 0), "remove and ban").otherwise("keep"))
    return agg.withColumn("action", action)


def dec_lifecycle(bundles: DataFrame, albums: DataFrame, root: DataFrame, *, now: int, min_stable_s: int = 300,
                  wanted_only: bool = True) -> DataFrame:
    """What to do with completed bundles.

    Bundles need ``hash, progress, n_selected, folder_exists, n_on_disk,
    newest, state``; albums need ``hash, have, total``.  An empty root vetoes
    everything: it is what a wrong mount looks like.  Nothing is removed with
    data unless at least one album is confirmed owned.
    """
    blocks = (zero("total") > 0) & ~F.col("have")
    plan = albums.groupBy("hash").agg(F.count_if(blocks).alias("n_blocking"), F.count_if("have").alias("n_owned"), F.count("*").alias("n_albums"))
    # a scalar subquery: one aggregated value, no join
    veto = root.limit(1).agg(F.count("*") == 0).scalar()
    b = bundles.withColumn("root_empty", veto).join(plan, "hash", "left")
    settled = (zero("n_blocking") == 0) if wanted_only else (zero("n_owned") == zero("n_albums"))
    done = settled & (zero("n_owned") >= 1) & (F.lit(now) - F.col("newest") >= min_stable_s)
    stopped = F.lower("state").contains("paused") | F.lower("state").contains("stopped")
    action = (F.when(F.col("root_empty"), "nothing: root is empty").when(F.col("progress") < 1.0, "nothing: downloading")
              .when(F.col("n_selected") == 0, "nothing: no audio selected")
              .when(~F.col("folder_exists"), "remove entry").when(F.col("n_on_disk") == 0, "remove with data")
              .when(done, "remove with data").when((F.col("n_on_disk") < F.col("n_selected")) & ~stopped, "pause").otherwise("keep"))
    return b.withColumn("action", action).drop("root_empty", "n_blocking", "n_owned", "n_albums")


def dec_dead(bundles: DataFrame, *, now: int, grace_s: int = fixed.DEAD_GRACE_S) -> DataFrame:
    """Grabs that never got anywhere.  Needs ``state, progress, added, num_seeds, num_complete``."""
    state = F.lower(text_or_empty("state"))
    silent = state.isin(*fixed.DOWNLOADING_STATES) & (zero("num_seeds") == 0) & (zero("num_complete") <= 0)
    age = F.when(zero("added") > 0, F.lit(now) - F.col("added")).otherwise(0)
    return bundles.filter((F.coalesce("progress", F.lit(0.0)) < 0.01) & (state.isin(*fixed.DEAD_STATES) | silent) & (age >= grace_s))


def dec_stalled(bundles: DataFrame, files: DataFrame, *, now: int, grace_s: int = fixed.STALLED_GRACE_S) -> DataFrame:
    """Salvage or trash for bundles that stopped halfway.

    Bundles need ``hash, state, progress, last_activity``; files need ``hash,
    progress, audio, needed, wanted``.
    """
    state = F.lower(text_or_empty("state"))
    p = F.coalesce("progress", F.lit(0.0))
    idle = (zero("last_activity") > 0) & (F.lit(now) - F.col("last_activity") >= grace_s)
    stuck = bundles.filter((p >= 0.01) & (p < 1.0) & ~state.contains("paused") & ~state.contains("stopped") & idle)
    useful = files.filter(F.col("audio") & (F.col("progress") >= 1.0) & (F.col("needed") | F.col("wanted"))) \
        .groupBy("hash").agg(F.count("*").alias("n_useful"))
    return stuck.join(useful, "hash", "left").withColumn("n_useful", zero("n_useful")) \
        .withColumn("action", F.when(F.col("n_useful") > 0, "salvage").otherwise("trash"))


def dec_leftovers(files: DataFrame, imported: DataFrame, matched: DataFrame) -> DataFrame:
    """Fate of the files of a harvested folder: imported, still wanted, leftover."""
    done = imported.select("path").distinct().withColumn("_i", F.lit(True))
    want = matched.select("path").distinct().withColumn("_w", F.lit(True))
    out = files.join(done, "path", "left").join(want, "path", "left")
    return out.withColumn("fate", F.when(F.col("_i"), "imported").when(F.col("_w") & F.col("audio"), "still wanted").otherwise("leftover")).drop("_i", "_w")


def leftover_totals(fates: DataFrame) -> DataFrame:
    return fates.groupBy("fate").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def removable_bundles(bundles: DataFrame, category: str) -> DataFrame:
    """Bundles of exactly the named category; an empty name selects none."""
    name = (category or "").strip().lower()
    same = F.lower(F.trim(text_or_empty("category"))) == name
    return bundles.filter(same if name else F.lit(False))


def dec_prefer_lossless(tracks: DataFrame) -> DataFrame:
    """Lossy files whose (album, track) also exists lossless."""
    twins = tracks.filter("lossless").select("album_id", "track_no").distinct()
    return tracks.filter(~F.col("lossless")).join(twins, ["album_id", "track_no"], "left_semi")


def dec_library_audit(disk: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Folders on disk against the catalogue.  Disk: ``album_id, n_disk``;
    catalogue: ``album_id, have, total``."""
    both = disk.join(catalogue, "album_id", "full_outer")
    n, have = zero("n_disk"), zero("have")
    cls = (F.when(F.col("total").isNull(), "missing record").when((n > 0) & (have == 0), "zero files")
           .when(n > have, "under-registered").when((n == 0) & (have > 0), "not on disk").otherwise("ok"))
    return both.select("album_id", n.alias("n_disk"), have.alias("have"), zero("total").alias("total"), cls.alias("class"))


def dec_import_admission(counts: DataFrame, *, missing_max: float = 0.10, extra_max: float = 0.25, partial_min: float = 0.50) -> DataFrame:
    """Admit an import by file count against release count (``n_files, total``)."""
    n, total = F.col("n_files"), F.col("total")
    short, extra = (total - n) / total, (n - total) / total
    verdict = (F.when(zero("total") <= 0, "unknown release").when(n == total, "exact")
               .when((n < total) & (short <= missing_max), "nearly complete").when((n > total) & (extra <= extra_max), "extras")
               .when(n > total, "compilation").when(n / total >= partial_min, "partial: keep source").otherwise("refuse"))
    return counts.withColumn("verdict", verdict)


def dec_image_folder(files: DataFrame, *, group: str, size: str, playing: str, ratio: float = 3.0, min_s: float = 1200.0) -> DataFrame:
    """One file far above the others that plays 20 minutes or more is an image."""
    med = upper_median(files, group=group, size=size)
    long_ = files.groupBy(group).agg(F.max_by(playing, size).alias("playing_s"))
    out = med.join(long_, group)
    image = ((F.col("n") == 1) | (F.col("largest") >= ratio * F.col("median"))) & (F.col("playing_s") >= min_s)
    return out.withColumn("kind", F.when(image, "disc image").otherwise("split"))


def dec_prefer_multichannel(folders: DataFrame) -> DataFrame:
    """Among sibling folders (``parent, folder, channels``) the one with most channels stays."""
    keep = folders.groupBy("parent").agg(F.max("channels").alias("_top"), F.max_by("folder", F.struct("channels", "folder")).alias("_keep"))
    return folders.join(keep, "parent").withColumn(
        "keep", (F.col("folder") == F.col("_keep")) | (F.col("_top") <= 2)).drop("_top", "_keep")


def dec_held_vs_library(held: DataFrame, library: DataFrame) -> DataFrame:
    """Is the held copy better than the library's?  ``turn`` numbers what fills a
    monitored gap; a pass takes the first few.  Both need the quality columns."""
    rank = lambda p: sim_quality_rank(f"{p}lossless", f"{p}channels", f"{p}bits", f"{p}rate")
    lib = library.select("album_id", *[F.col(c).alias(f"l_{c}") for c in ("lossless", "channels", "bits", "rate")], F.lit(True).alias("_lib"))
    out = held.join(lib, "album_id", "left")
    h, l = F.round(rank(""), 9), F.round(rank("l_"), 9)
    out = out.withColumn("verdict", F.when(F.col("_lib").isNull(), "not in library").when(h > l, "better").when(h < l, "worse").otherwise("same"))
    gap = (F.col("verdict") == "not in library") & F.coalesce("monitored", F.lit(False))
    turns = numbered(out.withColumn("_gap", gap), F.col("_gap").desc(), F.col("held_id").asc(), out="turn")  # gaps first, so they are numbered from 1
    return turns.select("held_id", "album_id", "verdict", F.when(F.col("_gap"), F.col("turn")).alias("turn"))


def dec_convert_selection(files: DataFrame, *, lossless_only: bool, copy_lossy: bool) -> DataFrame:
    lossy = ~F.col("format").isin(*fixed.LOSSLESS_EXT)
    action = F.when(F.lit(lossless_only) & lossy, "copy" if copy_lossy else "skip").otherwise("encode")
    return files.withColumn("action", action)


def dec_verdict_diff(old: DataFrame, new: DataFrame, *, key: str, verdict: str) -> DataFrame:
    """Keys whose verdict changed, appeared or vanished."""
    both = old.select(key, F.col(verdict).alias("old")).join(new.select(key, F.col(verdict).alias("new")), key, "full_outer")
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))
