"""A corpus pipeline of the library's training-data operators, one stage each.

``STAGES`` lists ``(name, function)``.  Each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame, which is written as Parquet and read again
as the ``docs`` of the next; all but the last keep the columns of documents.

Stages decide on rows, not on ids: a row is known by its ``doc_id`` and text, in
order of ``doc_id``, nulls last.  Rows that share an id but not the text are
documents of their own, rows with a null id too.  A null text is an empty one.
Empty tables give empty results, and columns beyond those of documents go
through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup, mixing, near_dedup, quality_rules
from ledgerline.llm.common import documents, held_out, staged, whole_text
from ledgerline.llm.queries import coded
from ledgerline.session import table


def _known(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column, and its name: text that sorts as the ids do and tells rows of one id apart by their texts."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return docs.withColumn(row, F.concat_ws(":", F.coalesce(number, F.lit("~")), F.hex(F.xxhash64(whole_text())))), row


def _only(docs: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """The documents whose ``row`` is among ``key``."""
    return docs.join(rows.select(F.col("key").alias(row)), row, "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list; repeated rows alike."""
    rows, row = _known(docs)
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    named = labels.join(rows.select("doc_id", row), "doc_id").select(row, "quality")
    judged = quality_rules.judged(rows, named, key=row, held=lambda _: F.lit(False))
    return _only(rows, row, judged.filter("kept")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id; of rows that repeat id and text one."""
    rows, row = _known(docs)
    first = _only(rows, row, exact_dedup.exact_dedup(rows, key=row).filter("kept"))
    return first.dropDuplicates([row]).select(*docs.columns)  # dealt by it already


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    rows, row = _known(docs)
    groups = near_dedup.near_groups(rows, key=row)
    return _only(rows, row, groups.filter(F.col("key") == F.col("component"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each row, with a row for each pass over it."""
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, a row per document and pass."""
    return coded(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("byte_bpe", encode)]

#: learned rules, signatures, a hashed mix and BPE are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
