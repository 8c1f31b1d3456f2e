"""Similarity scores.  They run over blocked pairs only, never over a product."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerline.functions.keys import key_credit_sets, key_identity_tokens
from ledgerline.functions.text import col, text_or_empty


@F.pandas_udf(DoubleType())
def udf_sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; the argument order matters (wanted, candidate)."""
    return pd.Series([
        SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def needs_ratio(a, b) -> Column:
    """Rows that the native branches of :func:`sim_title` cannot score."""
    a, b = text_or_empty(a), text_or_empty(b)
    return (a != "") & (b != "") & ~F.contains(a, b) & ~F.contains(b, a)


def sim_title_native(a, b) -> Column:
    """Exact and containment branches; NULL where the ratio is needed."""
    a, b = text_or_empty(a), text_or_empty(b)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0)
            .when(F.contains(a, b) | F.contains(b, a), F.lit(0.90) * (short / long) + F.lit(0.05)))


def sim_title(a, b) -> Column:
    """Full score.  NULL arguments keep the other rows out of Python quickly."""
    rest = needs_ratio(a, b)
    ratio = udf_sequence_ratio(F.when(rest, text_or_empty(a)), F.when(rest, text_or_empty(b)))
    return F.coalesce(sim_title_native(a, b), ratio)


def ratio_upper_bound(a, b) -> Column:
    """A bound the ratio can never exceed, from lengths alone."""
    la, lb = F.length(text_or_empty(a)), F.length(text_or_empty(b))
    return F.when(la + lb == 0, 1.0).otherwise(F.lit(2.0) * F.least(la, lb) / (la + lb))


def sim_identity_f1(found_title, wanted_title, artist) -> Column:
    want, got = key_identity_tokens(wanted_title, artist), key_identity_tokens(found_title, artist)
    both = F.size(F.array_intersect(want, got))
    recall, precision = both / F.size(want), both / F.size(got)
    return F.when((F.size(want) == 0) | (F.size(got) == 0) | (both == 0), 0.0).otherwise(
        F.lit(2.0) * recall * precision / (recall + precision))


def sim_credit_agree(a, b) -> Column:
    return F.coalesce(F.arrays_overlap(key_credit_sets(a), key_credit_sets(b)), F.lit(False))


def sim_substring_artist(key_a, key_b) -> Column:
    a, b = text_or_empty(key_a), text_or_empty(key_b)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def sim_quality_rank(lossless, channels, bits, rate) -> Column:
    zero = lambda c: F.coalesce(col(c).cast("double"), F.lit(0.0))
    return (F.when(F.coalesce(col(lossless), F.lit(False)), 2.0).otherwise(0.0)
            + F.when(zero(channels) > 2, 2.0).otherwise(0.0)
            + zero(channels) / 10 + zero(bits) / 100 + zero(rate) / 1e7)


def sim_edit_native(a, b) -> Column:
    a, b = text_or_empty(a), text_or_empty(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)
