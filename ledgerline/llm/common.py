"""Shared by the operators of this package: table access, staged tables, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import shared_folder, table

#: ASCII white space, as a Java character class; everything else belongs to words
SPACE = r"[\x20\x09-\x0D]"

#: labelled rows of this remainder are held out from all learning
HELD_OUT = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def new_folder(spark: SparkSession, label: str) -> str:
    """Name of a folder, not yet there, below the cluster's shared one."""
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` below the cluster's shared folder and go on from the files.

    Cuts the lineage: what several later branches read is computed once, and a
    lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def n_tasks(spark: SparkSession) -> int:
    """Tasks for work that its bytes do not show: an explicit number is not coalesced."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id, modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))
