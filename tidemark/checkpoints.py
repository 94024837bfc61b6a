"""Durable snapshots of window state: written whole or not at all, the last two kept, torn ones passed over.

A snapshot is a folder ``checkpoint-<offset>`` with Parquet tables ``panes`` and ``windows`` and a ``manifest`` of JSON
lines: the content, and its CRC-32C. The manifest holds each table's rows and an order-free sum of row hashes, both
taken by jobs over what was written, so that a check is a distributed read as well. A snapshot is made below a ``.tmp``
name, its manifest last, and renamed when it is whole; a reader never sees part of one under its own name, and what a
crash or a bad disk leaves is found by the sums. ``windows`` holds beside what has fired what waits to fire again, so an
update that was due at the crash is not lost.

Partitions have folders of their own (``p0``, ``p1``, ...); a set of snapshots is complete at an offset if all have it.
Version 1 snapshots have no ``windows`` and restore as if nothing had fired.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import crc32c

VERSIONS = (1, 2)
PANES = "key string, s long, sum long, count long"
WINDOWS = "s long, fired boolean, again boolean"
_NAME = re.compile(r"^checkpoint-(\d+)$")


@dataclass(frozen=True)
class Snapshot:
    """State after ``offset`` records: the watermark (None before the first), live panes, and their windows."""

    offset: int
    watermark: int | None
    panes: DataFrame
    windows: DataFrame


class Folder:
    """A path on any file system that Hadoop knows, so executors and driver see the same."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        here = self._path(self.path)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(here)) if self.fs.exists(here) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"{self.path}/{old} was not renamed")

    def write(self, name: str, data: bytes) -> None:
        out = self.fs.create(self.at(name), True)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()


def unreadable(error: Py4JJavaError) -> bool:
    """Whether the JVM failed since a file is missing, cut short or damaged, and not for another reason."""
    cause = error.java_exception
    while cause is not None:
        text = cause.toString()
        if "FAILED_READ_FILE" in text or text.startswith(("java.io.", "org.apache.hadoop.fs.")):
            return True
        cause = cause.getCause()
    return False


def _summary(table: DataFrame) -> dict[str, int]:
    """Rows, and the sum of their hashes modulo a prime below 2**31: the same in any order."""
    row = table.agg(F.count("*").alias("rows"), F.sum(F.pmod(F.xxhash64(*sorted(table.columns)), F.lit(2_147_483_647))).alias("sum")).first()
    return {"rows": row.rows, "sum": (row["sum"] or 0) % 2_147_483_647}


class CheckpointStore:
    """The snapshots of one pipeline, or of one partition of it."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2) -> None:
        self.spark, self.keep, self.folder = spark, keep, Folder(spark, path)

    def write(self, offset: int, watermark: int | None, panes: DataFrame, windows: DataFrame | None, version: int = 2) -> None:
        """Write a snapshot and delete all but the last ``keep``. panes: PANES, windows: WINDOWS (none in version 1)."""
        if version not in VERSIONS:
            raise ValueError(f"version {version} is unknown")
        part = f".tmp-{offset}-{uuid.uuid4().hex}"
        tables = {"panes": panes.select("key", "s", "sum", "count")}
        if version > 1:
            tables["windows"] = windows.select("s", "fired", "again")
        content = {"version": version, "offset": offset, "watermark": watermark}
        for name, table in tables.items():
            place = f"{self.folder.path}/{part}/{name}"
            table.write.parquet(place)
            content[name] = _summary(self.spark.read.schema(PANES if name == "panes" else WINDOWS).parquet(place))
        body = json.dumps(content, sort_keys=True).encode()
        self.folder.write(f"{part}/manifest", body + b"\n" + f"{crc32c(body):08x}\n".encode())
        final = f"checkpoint-{offset}"
        self.folder.delete(final)  # the same offset after a restart: the same state
        self.folder.rename(part, final)
        for old in self.listed()[: -self.keep]:
            self.folder.delete(f"checkpoint-{old}")

    def listed(self) -> list[int]:
        """Offsets of all snapshots by name, valid or not, ascending."""
        return sorted(int(m[1]) for n in self.folder.names() if (m := _NAME.match(n)))

    def load(self, offset: int) -> Snapshot | None:
        """The snapshot of exactly this offset, None if there is none or it is torn, damaged or of an unknown version."""
        name = f"checkpoint-{offset}"
        try:
            body, _, end = self.folder.read(f"{name}/manifest").partition(b"\n")
            if end != f"{crc32c(body):08x}\n".encode():
                return None
            content = json.loads(body)
            if content["version"] not in VERSIONS or content["offset"] != offset:
                return None
            tables = {}
            for table, schema in (("panes", PANES), ("windows", WINDOWS)):
                if table == "windows" and content["version"] == 1:
                    tables[table] = self.spark.createDataFrame([], WINDOWS)
                    continue
                tables[table] = self.spark.read.schema(schema).parquet(f"{self.folder.path}/{name}/{table}")
                if _summary(tables[table]) != content[table]:
                    return None
        except (PySparkException, ValueError, KeyError):
            return None
        except Py4JJavaError as e:
            if not unreadable(e):
                raise
            return None
        return Snapshot(offset, content["watermark"], tables["panes"], tables["windows"])

    def valid_offsets(self) -> list[int]:
        """Offsets of all snapshots that load, ascending; changes nothing."""
        return [o for o in self.listed() if self.load(o) is not None]

    def load_latest(self) -> Snapshot | None:
        """The newest snapshot that is whole, after deleting what crashed writers left."""
        for name in self.folder.names():
            if name.startswith(".tmp-"):
                self.folder.delete(name)
        return next((s for o in reversed(self.listed()) if (s := self.load(o)) is not None), None)


def partition_stores(spark: SparkSession, path: str, partitions: int, keep: int = 2) -> list[CheckpointStore]:
    return [CheckpointStore(spark, f"{path.rstrip('/')}/p{i}", keep) for i in range(partitions)]


def checkpoint_files(spark: SparkSession, stores: list[CheckpointStore]) -> DataFrame:
    """partition, offset: the whole snapshots of each partition, for ``operators.checkpoint.highest_complete`` and its like."""
    rows = [(i, o) for i, s in enumerate(stores) for o in s.valid_offsets()]  # two or so for each partition
    return spark.createDataFrame(rows, "partition int, offset long")


def load_complete(stores: list[CheckpointStore]) -> list[Snapshot] | None:
    """All partitions' snapshots of the greatest offset that each of them has whole; None if there is none."""
    sets = [set(s.valid_offsets()) for s in stores]
    common = set.intersection(*sets) if sets else set()
    return [s.load(max(common)) for s in stores] if common else None
