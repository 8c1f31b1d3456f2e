"""Counts and ratios of a text, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACE, whole_text, words

#: exact counts of a text
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_shouts",
          "n_bars", "n_marks", "n_distinct", "n_repeat_next", "longest_word")

#: ratios that models read, from the counts
RATIOS = ("chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "shouts_per_word",
          "bars_per_word", "marks_per_word", "distinct_share", "next_share", "words_per_line", "longest_word", "n_words")

#: words in a window that counts as repeated
WINDOW = 3


def _gone(text: Column, kept: str) -> Column:
    """Number of characters of the class ``kept``."""
    return F.char_length(F.regexp_replace(text, f"[^{kept}]+", ""))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``COUNTS``, one row per row of ``docs``; all long.

    A null or empty text has zeros.  Words are runs of characters other than
    ASCII white space.  ``n_repeat_words`` counts words in 3-word windows found
    twice or more in the text, the first included: equal 64-bit hashes of
    windows are brought together by a sort within the row, and what their
    positions cover is summed.
    """
    def lag(array: str, i: Column, step: int) -> Column:
        return F.get(F.col(array), i + step)

    parts = docs.select(F.col(key).alias("key"), whole_text(text).alias("_text")).select(
        "key", words(F.col("_text")).alias("_w"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(rf"[^\x20\x09-\x0D]")).alias("_lines"),
        # what is not plain prose is little; the counts of single characters read only that
        F.regexp_replace("_text", r"[a-zß-ÿ\x20\x09-\x0D]+", "").alias("_odd"))
    last = F.size("_w") - WINDOW
    hashed = parts.withColumn("_h", F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(F.col("_w"), i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>")))
    ordered = hashed.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    places = ordered.withColumn("_p", F.sort_array(F.transform(
        F.filter("_s", lambda x, i: (x["h"] == F.when(i > 0, lag("_s", i, -1)["h"])) | (x["h"] == lag("_s", i, 1)["h"])), lambda x: x["p"])))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.coalesce(lag("_p", i, 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, b: a + b)
    pairs = F.size(F.filter("_w", lambda w, i: w == F.when(i > 0, lag("_w", i, -1))))
    return places.select("key", *(c.cast("long").alias(n) for n, c in {
        "n_words": F.size("_w"),
        "word_chars": F.char_length(F.array_join("_w", "")),
        "n_symbols": _gone(F.col("_odd"), r"#*$%&|<>"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("_lines"),
        "n_upper": _gone(F.col("_odd"), r"A-ZÀ-Þ"),
        "n_digits": _gone(F.col("_odd"), "0-9"),
        "n_shouts": _gone(F.col("_odd"), "!?"),
        "n_bars": _gone(F.col("_odd"), "|"),
        "n_marks": _gone(F.col("_odd"), ".,;:"),
        "n_distinct": F.size(F.array_distinct("_w")),
        "n_repeat_next": pairs,
        "longest_word": F.coalesce(F.array_max(F.transform("_w", F.char_length)), F.lit(0)),
    }.items()))


def ratios() -> dict[str, Column]:
    """The columns of ``RATIOS`` over the counts; a text without words has zeros."""
    c = F.col
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    made = {
        "chars_per_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"), "upper_share": per("n_upper", "word_chars"), "digit_share": per("n_digits", "word_chars"),
        "shouts_per_word": per("n_shouts", "n_words"), "bars_per_word": per("n_bars", "n_words"), "marks_per_word": per("n_marks", "n_words"),
        "distinct_share": per("n_distinct", "n_words"), "next_share": per("n_repeat_next", "n_words"), "words_per_line": per("n_words", "n_lines"),
        "longest_word": c("longest_word"), "n_words": c("n_words"),
    }
    return {n: made[n].cast("double") for n in RATIOS}
