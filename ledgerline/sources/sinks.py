"""Sinks: reports, and state snapshots with optimistic commits."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: versions of a snapshot that stay for readers that have begun on them
KEEP = 3


def sink_report(df: DataFrame, folder: str, fmt: str = "csv", *, single_file: bool = False) -> None:
    """Write a report.  ``single_file`` is for small top-k reports only."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(folder) if fmt == "csv" else writer.json(folder)


class _Log:
    """The log of a snapshot: one small file for each version, created only if absent.

    An entry names the folder of its data and the last batch of each stream
    that the data hold.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.jvm = spark, spark._jvm
        self.folder, self.root = folder, self.jvm.org.apache.hadoop.fs.Path(f"{folder}/_log")
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, version: int):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, f"{version:020d}.json")

    def versions(self) -> list[int]:
        if not self.fs.exists(self.root):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.root)]
        return sorted(int(n[:20]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def read(self, version: int) -> dict:
        stream = self.fs.open(self._path(version))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def last(self) -> tuple[int, dict]:
        versions = self.versions()
        return (versions[-1], self.read(versions[-1])) if versions else (0, {"data": None, "batches": {}})

    def create(self, version: int, entry: dict) -> bool:
        """Whether the entry is ours: False if another writer was first."""
        data = bytearray(json.dumps(entry).encode())
        path = self._path(version)
        self.fs.mkdirs(self.root)
        if self.fs.getUri().getScheme() == "file":  # Hadoop's local create tests before it writes; this does both at once
            option = self.jvm.java.nio.file.StandardOpenOption
            options = self.spark.sparkContext._gateway.new_array(self.jvm.java.nio.file.OpenOption, 2)
            options[0], options[1] = option.CREATE_NEW, option.WRITE
            try:
                self.jvm.java.nio.file.Files.write(self.jvm.java.nio.file.Path.of(self.fs.makeQualified(path).toUri()), data, options)
            except Py4JJavaError as error:
                if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                    return False
                raise
            return True
        try:
            stream = self.fs.create(path, False)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        stream.write(data)
        stream.close()
        return True

    def prune(self, keep: int) -> None:
        """Remove versions before the last ``keep``; data that no entry names any more go with their entry."""
        for version in self.versions()[:-keep]:
            try:
                data = self.read(version)["data"]
            except Py4JJavaError:  # another writer has pruned it meanwhile
                continue
            self.remove(data)
            self.fs.delete(self._path(version), False)

    def remove(self, data: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{data}"), True)


def commit_snapshot(spark: SparkSession, folder: str, step: Callable[[DataFrame | None], DataFrame], *, stream: str | None = None, batch: int | None = None, keep: int = KEEP) -> int | None:
    """Replace a snapshot by what ``step`` makes of it; returns the new version.

    The new data are written next to the old ones, then an entry of the log is
    created for the next version.  If another writer has created it first, the
    step is applied again to what that one has written: no update is lost.  With
    ``stream`` and ``batch`` the entry notes the batch, and one that it notes
    already changes nothing (None): a batch replayed after a crash counts once,
    whether or not it gave rows.  Readers see whole versions.
    """
    log = _Log(spark, folder)
    while True:
        version, entry = log.last()
        if stream is not None and entry["batches"].get(stream, -1) >= batch:
            return None
        data = f"v={version + 1}-{uuid.uuid4().hex}"
        old = None if entry["data"] is None else spark.read.parquet(f"{folder}/{entry['data']}")
        step(old).write.parquet(f"{folder}/{data}")
        batches = entry["batches"] | ({stream: batch} if stream is not None else {})
        if log.create(version + 1, {"data": data, "batches": batches}):
            log.prune(keep)
            return version + 1
        log.remove(data)


def sink_snapshot_swap(df: DataFrame, folder: str) -> int:
    """Make ``df`` the new version of a snapshot, whatever it was before.  Returns the version."""
    return commit_snapshot(df.sparkSession, folder, lambda _: df)


def snapshot_version(spark: SparkSession, folder: str) -> int | None:
    """The last version, or None before the first commit."""
    return _Log(spark, folder).last()[0] or None


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last version's data."""
    data = _Log(spark, folder).last()[1]["data"]
    return None if data is None else spark.read.parquet(f"{folder}/{data}")
