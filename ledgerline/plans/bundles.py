"""What not to download: files of a bundle against the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import keys, predicates
from ledgerline.operators import decisions, joins, rollups, sets


def narrow_bundles(files: DataFrame, albums: DataFrame, releases: DataFrame, needed: DataFrame) -> DataFrame:
    """Files with ``drop`` and ``apply``.

    Files need ``hash, idx, bundle, path, size, priority``; albums as in
    ``join_album_owned``; needed holds the paths assembly plans ask for.
    """
    f = files.withColumn("album_dir", keys.key_path_album_dir("path", "bundle"))
    parts = keys.path_parts("album_dir")
    top = F.when(F.size(parts) >= 2, F.get(parts, F.lit(0))).otherwise(F.col("bundle"))
    folders = (rollups.agg_bundle_plan(f).join(f.groupBy("hash", "album_dir").agg(F.min("bundle").alias("bundle")), ["hash", "album_dir"])
               .withColumn("artist", keys.key_folder_artist(top)).withColumn("hint", keys.file_name("album_dir"))
               .withColumn("title", keys.key_folder_album("hint", "artist")).withColumn("folder_id", F.struct("hash", "album_dir")))
    verdict = joins.join_album_owned(folders, albums)
    room = releases.groupBy("album_id").agg(F.max("track_count").alias("room"))
    plan = (folders.join(verdict, "folder_id").join(room, "album_id", "left")
            .withColumn("noise", predicates.is_noise_category("album_dir")).withColumn("unofficial", predicates.is_unofficial_title("title")))
    plan = decisions.dec_deselect(plan).select(
        "hash", "album_dir", F.col("drop").alias("owned"), ((F.col("total") > 0) & ~F.col("drop")).alias("wanted"), "reason")
    flagged = joins.join_keep_semi(f.join(plan, ["hash", "album_dir"], "left"), needed)
    off = F.lit(False)
    ready = flagged.withColumns({
        "owned": F.coalesce("owned", off), "wanted": F.coalesce("wanted", off), "video": predicates.is_video_file("path"),
        "audio": predicates.is_audio_file("path"), "dropped_before": F.col("priority") == 0})
    return sets.set_drop_merge(ready)
