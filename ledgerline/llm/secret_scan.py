"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the hash of its content.  The
ledger holds what each rule version found in each blob, so a scan reads only
blobs that some rule in its present version has not seen, each once however
many paths or versions carry it, and joins the findings back to all paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import staged, whole_text

#: copies of the findings for the join back to the paths, so that a blob on very many paths is joined in as many tasks
SALTS = 16

LEDGER_SCHEMA = "blob string, rule string, version int, spans array<struct<start: int, end: int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern, in Java syntax; a match counts if its ``group`` has ``least`` characters or more."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: in the order in which spans of one start are listed
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", 1, r"[0-9a-f]{24,}+"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", base=False),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", base=False),
)


def spans(text: Column, rule: Rule) -> Column:
    """``array<struct<start, end>>`` of the leftmost non-overlapping matches that count.

    The pieces between the matches and the matches alternate in the text, so
    their lengths, in code points, add up to the offsets.
    """
    start_end = "array<struct<start: int, end: int>>"
    gaps, hits = F.split(text, rule.pattern), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    matches = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), tested.alias("tested"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.char_length(m["gap"])
        end = start + F.char_length(m["hit"])
        found = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.char_length(m["tested"]) >= rule.least, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(start_end).alias("out"))
    return F.when(text.rlike(rule.pattern), F.aggregate(matches, first, step)["out"]).otherwise(F.array().cast(start_end))


def read_ledger(spark, folder: str) -> DataFrame:
    """The ledger, empty where there is none yet; each pair once."""
    try:
        rows = spark.read.schema(LEDGER_SCHEMA).parquet(folder)
    except AnalysisException:
        none = F.lit(None)
        return spark.range(0).select(none.cast("string").alias("blob"), none.cast("string").alias("rule"), none.cast("int").alias("version"),
                                     none.cast("array<struct<start: int, end: int>>").alias("spans"))
    return rows.dropDuplicates(["blob", "rule", "version"])


def scan(versions: DataFrame, ledger: str, path: str = "path", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger lacks, add it there, and return ``path, blob, findings``.

    One row per row of ``versions``, repeated rows too; ``findings`` is an array
    of ``rule, start, end`` in order of start and rule, empty if there are
    none.  A null text is an empty blob, a null path a path like others.  A blob
    is scanned once for each rule, whatever paths, versions and repeated rows
    carry it, and however long it is.  An empty table gives an empty result and
    adds nothing; other columns are not read.
    ``ledger`` is a folder every executor reaches.  A run that dies while it
    scans adds nothing; two runs at once may add a pair twice, which readers
    count once.
    """
    spark = versions.sparkSession
    # the ledger as it is now: the scan adds to it
    current = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    addressed = staged(versions.select(F.col(path).alias("path"), F.sha2(whole_text(text), 256).alias("blob")), "blobs")
    blobs = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    due = (blobs.withColumn("r", F.explode(current)).select("blob", "path", "r.*")
           .join(read_ledger(spark, ledger).select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti")
           .groupBy("blob", "path").agg(F.collect_set("rule").alias("due")))
    texts = versions.select(F.col(path).alias("_path"), F.xxhash64(path).alias("_k"), whole_text(text).alias("_text")).withColumn("_blob", F.sha2("_text", 256))
    named = due.withColumn("_due_k", F.xxhash64("path"))
    # repeated rows of the least path are one text, grouped by what they are joined by
    unseen = (texts.join(named, (F.col("_k") == F.col("_due_k")) & (F.col("_blob") == F.col("blob"))).filter(F.col("_path").eqNullSafe(F.col("path")))
              .groupBy("_k", "_blob").agg(F.first("_text").alias("_text"), F.first("due").alias("due")).withColumnRenamed("_blob", "blob"))
    pairs = F.array(*(F.when(F.array_contains("due", r.name), F.struct(
        F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("_text"), r).alias("spans"))) for r in rules))
    (unseen.select("blob", F.explode(pairs).alias("p")).filter("p IS NOT NULL").select("blob", "p.*")
     .write.mode("append").parquet(ledger))

    order = {r.name: i for i, r in enumerate(rules)}
    wanted = [f"{r.name}/{r.version}" for r in rules]
    listed = F.create_map(*(x for name, i in order.items() for x in (F.lit(name), F.lit(i))))
    found = (read_ledger(spark, ledger).filter(F.size("spans") > 0).filter(F.concat_ws("/", "rule", "version").isin(wanted))
             .select("blob", F.explode(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), listed[F.col("rule")].alias("kind"), F.col("rule"), s["end"].alias("end")))).alias("s"))
             .groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("_s"))
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = addressed.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return salted.join(found, ["blob", "_salt"], "left").select("path", "blob", F.coalesce(
        F.transform("_s", lambda s: F.struct(s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end"))),
        F.array().cast("array<struct<rule: string, start: int, end: int>>")).alias("findings"))
