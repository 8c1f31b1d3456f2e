"""Plan missing albums from songs at hand, and hunt releases for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import keys, similarity
from ledgerline.operators import joins, ranking, rollups, state


def plan_albums(tracks: DataFrame, sources: DataFrame, stored: DataFrame | None = None, *, now: int, fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """(track rows, album plans) for albums whose artist the sources mention at all."""
    names = sources.select(F.explode(F.concat("strong", "weak")).alias("want_artist"))
    present = joins.join_presence_semi(tracks.filter("NOT various"), names, key="want_artist").unionByName(
        tracks.filter("various"), allowMissingColumns=True)
    rows, totals = rollups.agg_plan_album(present, sources, fuzzy=fuzzy)
    plans = totals.withColumnRenamed("album_id", "id").withColumn("created", F.lit(now))
    return rows, plans if stored is None else state.st_upsert_plan(stored, plans)


def hunt_queries(carried: DataFrame, artist: str, *, exclude: DataFrame | None = None) -> DataFrame:
    """Search terms of the releases that carry missing tracks, with how many they carry; a hunt tries the best first."""
    best = rollups.agg_coverage_rank(carried, exclude=exclude)
    return best.select("release_key", "coverage", "title", F.posexplode(keys.key_search_variants("title", F.lit(artist))).alias("pos", "term"))


def rank_found(found: DataFrame, *, minimum: float = 0.6) -> DataFrame:
    """Search results that plausibly are the release asked for, best first."""
    scored = found.withColumn("score", similarity.sim_identity_f1("found_title", "title", "artist"))
    return ranking.win_rank_candidates(scored.filter(F.col("score") >= minimum), group="release_key")
