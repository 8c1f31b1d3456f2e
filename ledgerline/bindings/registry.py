"""Queries and their SQL twins, registered side by side.

``DERIVED`` holds inputs computed from the given tables by plain SQL that both
engines accept.  They give the operators realistic titles, credits and paths
and grow with the tables they come from.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import table

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DERIVED: dict[str, str] = {}


# inputs that costly text expressions run over: their base table and a unique key
SPREAD = {"files": ("lineitem", "file_id"), "songs": ("lineitem", "ordinal"), "tracks": ("lineitem", "track_id"),
          "documents": ("documents", "doc_id"), "conversations": ("conversations", "text")}


class Inputs:
    """The given tables and the derived ones, by attribute, for one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self._plain(name)
        if name not in SPREAD:
            return df
        # a file of one row group is read by one task, whatever the cores; at
        # scale the scan has more splits than cores and nothing is moved
        base, key = SPREAD[name]
        cores = self.spark.sparkContext.defaultParallelism
        few = self._plain(base).rdd.getNumPartitions() < cores
        return df.repartition(cores, key) if few else df

    def _plain(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.folder, name)
        if name in DERIVED:
            sql = DERIVED[name]
            used = {n: self._plain(n) for n in _names_in(sql)}
            text = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0],
                          sql.replace("{", "{{").replace("}", "}}"))
            return self.spark.sql(text, **used)
        raise AttributeError(name)


def _names_in(sql: str) -> list[str]:
    return sorted({m for m in re.findall(r"\b(?:FROM|JOIN) (\w+)", sql) if m in TABLES or m in DERIVED})


def with_derived(sql: str) -> str:
    """Prefix a query with the CTEs of the derived tables it reads."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _names_in(text):
            if name in DERIVED and name not in order:
                visit(DERIVED[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({DERIVED[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_derived(oracle)
        return fn

    return register
