"""Readers: file listings, nested catalogue snapshots, paged dumps, text sheets."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerline.functions import fixed
from ledgerline.functions.keys import file_ext


def src_scan_files(spark: SparkSession, root: str, extensions: Iterable[str] = ()) -> DataFrame:
    """Recursive listing by extension.  Contents are pruned: no file is opened."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")))
    wanted = tuple(e.lower().lstrip(".") for e in extensions)
    if wanted:
        files = files.filter(file_ext("path").isin(*wanted))
    return files


def src_catalogue_snapshot(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(albums, releases, tracks) of nested album records.

    Records hold ``id, title, monitored, artist{id,name}, statistics{have,
    total}, releases[], tracks[]``; missing flags take their defaults.
    """
    albums = records.select(
        F.col("id").alias("album_id"), "title", F.coalesce("monitored", F.lit(False)).alias("monitored"), F.col("artist.id").alias("artist_id"),
        F.coalesce("statistics.have", F.lit(0)).alias("have"), F.coalesce("statistics.total", F.lit(0)).alias("total"))
    releases = records.select(F.col("id").alias("album_id"), F.posexplode("releases").alias("ordinal", "r")).select("album_id", "ordinal", "r.*")
    tracks = records.select(F.col("id").alias("album_id"), F.explode("tracks").alias("t")).select("album_id", "t.*")
    if "monitored" in tracks.columns:
        tracks = tracks.withColumn("monitored", F.coalesce("monitored", F.lit(True)))
    return albums, releases, tracks


def src_paged_dump(pages: DataFrame, *, id_field: str) -> tuple[DataFrame, DataFrame]:
    """(distinct records, one-row completeness check) of paged results.

    Pages hold ``page, total_records, records[]``.  A record seen on two pages
    counts once, from its first page.  The dump is complete only if as many
    distinct records arrived as any page announced.
    """
    rows = pages.select("page", "total_records", F.posexplode("records").alias("pos", "rec"))
    picked = rows.groupBy(F.col(f"rec.{id_field}").alias("_id")).agg(F.min_by("rec", F.struct("page", "pos")).alias("rec"))
    announced = pages.agg(F.max("total_records").alias("announced"))
    check = picked.agg(F.count("*").alias("received")).withColumn("announced", announced.scalar())
    return picked.select("rec.*"), check.withColumn("complete", F.col("received") >= F.coalesce("announced", F.lit(0)))


def _high(encoding: str) -> tuple[str, str]:
    """The upper half of a single-byte encoding: the characters that ISO-8859-1 reads its bytes as, and those they stand for."""
    pairs = [(chr(b), bytes([b]).decode(encoding, "ignore")) for b in range(128, 256)]
    return "".join(x for x, y in pairs if y), "".join(y for _, y in pairs)


def _unknown(encoding: str) -> str:
    """Bytes without a meaning in a single-byte encoding, as ISO-8859-1 characters."""
    return "".join(chr(b) for b in range(128, 256) if not bytes([b]).decode(encoding, "ignore"))


#: encodings that a table of characters decodes; the rest of the list goes through Python
_TABLES = ("cp1251", "cp1252")
_LATER = fixed.SHEET_ENCODINGS[fixed.SHEET_ENCODINGS.index(_TABLES[-1]) + 1:]


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))  # no session is needed yet
def _decoded_later(content: pd.Series) -> pd.DataFrame:
    """Bytes that no table decodes, by the encodings after those with one; null for null."""
    def one(raw: bytes | None) -> tuple[str | None, str | None]:
        for name in _LATER if raw is not None else ():
            try:
                return bytes(raw).decode(name), name
            except UnicodeDecodeError:
                pass
        return (None, None) if raw is None else (bytes(raw).decode("utf-8", errors="replace"), "replaced")

    return pd.DataFrame([one(x) for x in content], columns=["text", "encoding"])


def decode_sheets(files: DataFrame, *, content: str = "content") -> DataFrame:
    """Decode bytes with the first encoding that accepts them.

    UTF-8, with or without a byte order mark, and single-byte encodings are
    decoded natively: bytes read as ISO-8859-1, then translated by the
    encoding's table.  Python sees only what has bytes that none of these
    knows.  Null content has null text.
    """
    keep = [f.name for f in files.schema.fields if f.name != content]
    raw = F.col(content)
    plain = F.is_valid_utf8(raw.cast("string"))
    latin = F.decode(raw, "ISO-8859-1")
    known = {name: ~F.col("_latin").rlike("[" + "".join(f"\\x{ord(c):02x}" for c in _unknown(name)) + "]") for name in _TABLES}
    rows = files.select(*keep, content, plain.alias("_plain"), F.when(~plain, latin).alias("_latin"))
    which = F.when(F.col("_plain"), fixed.SHEET_ENCODINGS[0])
    text = F.when(F.col("_plain"), F.regexp_replace(raw.cast("string"), "^\ufeff", ""))
    for name in _TABLES:
        which = which.when(known[name], name)
        text = text.when(known[name], F.translate("_latin", *_high(name)))
    named = rows.withColumn("_which", which).withColumn("_text", text)
    later = _decoded_later(F.when(F.col("_which").isNull(), raw))
    return named.withColumn("_later", later).select(*keep, F.coalesce("_text", "_later.text").alias("text"), F.coalesce("_which", "_later.encoding").alias("encoding"))


def src_sheet_corpus(spark: SparkSession, root: str, extension: str = "cue") -> DataFrame:
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", f"*.{extension}").load(root).select("path", "content"))
    return decode_sheets(files)
