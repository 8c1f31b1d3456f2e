"""Songs on disk to import rows for wanted tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import fixed
from ledgerline.operators import joins, ranking, state
from ledgerline.operators.common import kept


def harvest(sources: DataFrame, tracks: DataFrame, albums: DataFrame, *, ledger: DataFrame | None = None,
            tolerance: int = fixed.DURATION_TOLERANCE_MS) -> DataFrame:
    """Each source once: matched, duplicate or rejected with a reason.

    Sources need ``ordinal, key, signature, title, artist, duration_ms``;
    sources whose signature the ledger already holds are skipped.
    """
    todo = sources if ledger is None else state.st_change_gate(sources, ledger)
    wanted = joins.flt_wanted(tracks, albums).select("ordinal", "title", "artist", "album", "duration_ms")
    # read for the matched and for the rejected
    judged = kept(joins.join_four_gates(todo, wanted, tolerance=tolerance))
    paired = ranking.win_one_per_track(judged.filter("want_ordinal IS NOT NULL"))
    lost = judged.filter("want_ordinal IS NULL").withColumn("outcome", F.lit("rejected"))
    return paired.drop("kept").unionByName(lost)


def import_rows(paired: DataFrame, fingerprints: DataFrame, quality: DataFrame, *, minimum: float = 0.5) -> DataFrame:
    """Verify matched rows by fingerprint, then attach the quality they need."""
    checked = joins.join_fingerprint_verify(paired, fingerprints, minimum=minimum)
    return joins.join_import_rows(checked.filter("verdict <> 'rejected'").drop("reason"), quality)
