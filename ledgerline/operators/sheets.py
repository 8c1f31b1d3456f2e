"""Text sheets (one audio image, many tracks) to sheet and track tables.

Lines are exploded and folded with native functions: the running track of a
line is the last track line before it.  The shuffle key is the sheet, whose
size is that of one text file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import fixed
from ledgerline.functions.fixed import ANY_BRACKETS
from ledgerline.functions.text import rx, text_or_empty
from ledgerline.operators.ranking import win_sheet_end_times
from ledgerline.operators.rollups import agg_majority

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
#: what a pattern's white space is, for trimming without one
BLANKS = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
INDEX_LINE = r"(?i)INDEX\s+(\d+)\s+(\d+):(\d+):(\d+)"


def _value(line: Column, keyword: int) -> Column:
    body = F.trim(F.substr(line, F.lit(keyword + 1)))
    quoted = F.regexp_extract(body, '"([^"]*)"', 1)
    bare = F.regexp_replace(body, '^"+|"+$', "")
    return F.when(body.rlike('"[^"]*"'), quoted).otherwise(bare)


def _rest(line: Column, pattern: str) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(line, pattern, "")), '^"+|"+$', "")


def _opens(word: str) -> Column:
    return F.lower(F.substring("line", 1, len(word))) == word


def sheet_lines(sheets: DataFrame, *, sheet: str = "sheet_id", text: str = "text") -> DataFrame:
    """One row per non-empty line, with the line number of its running track."""
    lines = sheets.select(sheet, F.posexplode(F.split(F.col(text), LINE_BREAK)).alias("no", "raw"))
    lines = lines.withColumn("line", F.btrim("raw", F.lit(BLANKS))).filter("line <> ''").drop("raw")
    # plain comparisons first: a pattern costs many times as much
    is_track = _opens("track") & F.col("line").rlike(r"(?iU)^TRACK\s+\d+(\s|$)")
    running = F.last(F.when(is_track, F.col("no")), ignorenulls=True).over(
        Window.partitionBy(sheet).orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lines.withColumn("track_at", running).withColumn("is_track", is_track)


def job_parse_sheets(sheets: DataFrame, *, sheet: str = "sheet_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sheet rows, track rows) of a corpus of sheets.

    Sheets need ``sheet_id, text, folder, duration_s``.  The last of repeated
    values wins; only INDEX 01 sets a start; 75 frames make a second.
    """
    lines = sheet_lines(sheets, sheet=sheet, text=text)
    line = F.col("line")
    starts = lambda word: F.startswith(F.upper(line), F.lit(word))
    newest = lambda cond, value: F.max_by(F.when(cond, value), F.when(cond, F.col("no")))
    in_track = F.col("track_at").isNotNull()
    number = F.regexp_extract(line, r"(?iU)^TRACK\s+(\d+)", 1).cast("int")
    part = lambda i: F.regexp_extract(line, INDEX_LINE, i).cast("int")
    index01 = starts("INDEX ") & line.rlike(INDEX_LINE)
    seconds = part(2) * 60 + part(3) + part(4) / F.lit(float(fixed.FRAMES_PER_SECOND))
    isrc = F.trim(F.regexp_replace(line, r"^\S+\s+", ""))

    tracks = (lines.filter(in_track).withColumn("one", index01 & (F.coalesce(F.when(index01, part(1)), F.lit(-1)) == 1))
              .groupBy(sheet, F.col("track_at").alias("position")).agg(
                  newest(F.col("is_track"), number).alias("number"), newest(starts("TITLE "), _value(line, 5)).alias("title"),
                  newest(starts("PERFORMER "), _value(line, 9)).alias("performer"), newest(starts("ISRC "), isrc).alias("isrc"),
                  F.coalesce(newest(F.col("one"), seconds), F.lit(0.0)).alias("start_s")))
    tracks = tracks.withColumns({c: text_or_empty(c) for c in ("title", "performer", "isrc")})

    file_ref = F.when(starts("FILE ") & line.rlike('"[^"]*"'), F.regexp_extract(line, '"([^"]*)"', 1))
    rem = lambda word: newest(_opens("rem") & line.rlike(rf"(?i)^REM\s+{word}\s"), _rest(line, rf"(?i)^REM\s+{word}\s+"))
    of_head = starts("FILE ") | _opens("rem") | (~in_track & (starts("TITLE ") | starts("PERFORMER ")))
    heads = lines.filter(of_head).groupBy(sheet).agg(
        newest(~in_track & starts("TITLE "), _value(line, 5)).alias("title"),
        newest(~in_track & starts("PERFORMER "), _value(line, 9)).alias("performer"),
        rem("DATE").alias("date"), rem("GENRE").alias("genre"), rem("COMMENT").alias("comment"),
        F.count(file_ref).alias("n_files"), F.coalesce(F.bool_or(file_ref.rlike(r"[/\\]")), F.lit(False)).alias("has_separator"))
    star = agg_majority(tracks.filter("performer <> ''"), group=sheet, value="performer", ordinal="position") \
        .select(sheet, F.col("performer").alias("_star"))

    folder = F.regexp_replace(rx(rx(text_or_empty("folder"), ANY_BRACKETS, " "), r"\s{2,}", " "), r"^[ \-_.]+|[ \-_.]+$", "")
    edge = lambda c: F.regexp_replace(c, r"^[ \-_.]+|[ \-_.]+$", "")
    has_artist = F.contains(folder, F.lit(" - "))
    f_artist = F.when(has_artist, edge(F.substring_index(folder, " - ", 1))).otherwise("")
    f_album = F.when(has_artist, edge(F.regexp_replace(folder, r"^.*? - ", ""))).otherwise(folder)
    blank = lambda c: F.nullif(text_or_empty(c), F.lit(""))
    out = (sheets.select(sheet, "folder", "duration_s").join(heads, sheet, "left").join(star, sheet, "left")
           .withColumn("title", F.coalesce(blank("title"), f_album))
           .withColumn("performer", F.coalesce(blank("performer"), F.col("_star"), f_artist))
           .withColumns({c: text_or_empty(c) for c in ("date", "genre", "comment")})
           .withColumn("n_files", F.coalesce("n_files", F.lit(0))).withColumn("has_separator", F.coalesce("has_separator", F.lit(False)))
           .drop("_star", "folder"))
    ended = win_sheet_end_times(tracks.join(sheets.select(sheet, "duration_s"), sheet), sheet=sheet).drop("duration_s")
    return out, ended
