"""Structured Streaming forms of the state operators.

Each has a batch twin in ``ledgerline.operators.state`` and gives the same rows
once the stream has drained.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ledgerline.operators import state as S
from ledgerline.sources.sinks import commit_snapshot, read_snapshot


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream one of the tables; later files of that name pattern follow on."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def first_sightings(producers: dict[str, DataFrame], ledger: str, checkpoint: str, *, key: str) -> None:
    """Note every key once, with the producer that reported it first.

    The producers' streams go into one query.  Sightings are kept in a ledger,
    one folder for each micro-batch, not in state that would expire: a key that
    comes again after any time, or after a restart, is known.  A replayed batch
    writes its folder anew.  In one batch the first producer in order of name counts.
    """
    named = [s.select(F.col(key).alias("key"), F.lit(name).alias("producer")) for name, s in producers.items()]
    stream = named[0]
    for other in named[1:]:
        stream = stream.unionByName(other)

    def note(batch: DataFrame, batch_id: int) -> None:
        new = batch.filter("key IS NOT NULL").groupBy("key").agg(F.min("producer").alias("producer"))
        seen = read_sightings(batch.sparkSession, ledger, new.schema).filter(F.col("batch") < batch_id)
        new.join(seen, "key", "left_anti").write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_sightings(spark: SparkSession, ledger: str, schema: StructType) -> DataFrame:
    """The ledger of :func:`first_sightings`: ``key, producer, batch``; empty before its first batch."""
    whole = StructType([*schema.fields, StructField("batch", LongType())])
    try:
        return spark.read.schema(whole).parquet(ledger)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def run_to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drain the available input into parquet and stop.  State is kept in RocksDB, on disk."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", folder)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def fold_into_snapshot(stream: DataFrame, snapshot: str, checkpoint: str, step: Callable[[DataFrame | None, DataFrame, int], DataFrame],
                       after: Callable[[DataFrame, int], None] | None = None) -> None:
    """Per micro-batch: ``step`` makes a new version of the snapshot of the last one and the batch.

    The commit notes the batch under the stream's checkpoint, so a replayed
    batch changes nothing.  ``after`` sees the committed snapshot, on a replay
    too: what it does happens at least once.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        commit_snapshot(spark, snapshot, lambda old: step(old, batch, batch_id), stream=checkpoint, batch=batch_id)
        if after is not None:
            after(read_snapshot(spark, snapshot), batch_id)

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_held(stream: DataFrame, snapshot: str, checkpoint: str, **options) -> None:
    """Streaming twin of ``st_upsert_held``; ``st_held_rows`` reads the snapshot.  Late and repeated updates do no harm."""

    def step(old: DataFrame | None, batch: DataFrame, _: int) -> DataFrame:
        folded = S.st_held_fold(batch, **options)
        return folded if old is None else S.st_held_merge(old, folded)

    fold_into_snapshot(stream, snapshot, checkpoint, step)


def gate_changes(stream: DataFrame, snapshot: str, checkpoint: str, judge: Callable[[DataFrame], None]) -> None:
    """Streaming twin of ``st_change_gate``: judge only changed signatures.

    The stream carries ``key, signature, ts``; the newest signature of a key in
    a batch counts.  The ledger is committed first and tells in which batch a
    signature came, so what is judged is read from it.
    """

    def step(old: DataFrame | None, batch: DataFrame, batch_id: int) -> DataFrame:
        now = batch.groupBy("key").agg(F.max_by("signature", "ts").alias("signature"))
        if old is None:
            return now.withColumn("batch", F.lit(batch_id))
        changed = S.st_change_gate(now, old).withColumn("batch", F.lit(batch_id))
        return S.st_change_mark(old, changed)

    fold_into_snapshot(stream, snapshot, checkpoint, step, lambda ledger, batch_id: judge(ledger.filter(F.col("batch") == batch_id).drop("batch")))
