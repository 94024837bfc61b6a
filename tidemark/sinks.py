"""Where results go: memory, standard output, and durable folders that can be read back after a crash.

A sink takes whole frames (``emit``) with a number that is the same when a batch runs again, and is flushed at the end.
``for_each_batch`` makes any of them the target of a stream; ``per_partition`` gives each partition a sink of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any, Protocol, TextIO

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoints import Folder, _summary, unreadable
from tidemark.functions.hashing import crc32c

RESULT = "key string, window_start_ms long, window_end_ms long, sum long, count long"


class Sink(Protocol):
    def emit(self, results: DataFrame, number: int) -> None:
        """Take the results (RESULT) of batch ``number``."""

    def flush(self) -> None:
        """All batches have been emitted."""


class MemorySink:
    """Keeps results on the driver, batch by batch; for tests and small results."""

    def __init__(self) -> None:
        self.batches: dict[int, list[Any]] = {}

    def emit(self, results: DataFrame, number: int) -> None:
        self.batches[number] = results.collect()

    def flush(self) -> None:
        pass

    @property
    def rows(self) -> list[Any]:
        return [r for n in sorted(self.batches) for r in self.batches[n]]

    def clear(self) -> None:
        self.batches.clear()


def line(row: Any) -> str:
    """A result as text."""
    return f"window=[{row.window_start_ms}, {row.window_end_ms}) key={row.key} sum={row['sum']} count={row['count']}"


class StdoutSink:
    """Prints a line for each result, a partition at a time."""

    def __init__(self, out: TextIO | None = None) -> None:
        self.out = out or sys.stdout

    def emit(self, results: DataFrame, number: int) -> None:
        for row in results.toLocalIterator():
            print(line(row), file=self.out)

    def flush(self) -> None:
        self.out.flush()


class DurableSink:
    """A folder for each batch, committed by a small file that names its rows and their sum of hashes.

    The results are written before their commit, so a batch without one, or whose rows differ from it, is the torn tail
    of a crash: ``read_all`` passes over it and all later ones. A batch that runs again replaces its folder.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def emit(self, results: DataFrame, number: int) -> None:
        place = f"{self.folder.path}/batch-{number:012d}"
        self.folder.delete(f"commit-{number:012d}")
        results.select(*(c.split()[0] for c in RESULT.split(", "))).write.mode("overwrite").parquet(place)
        found = _summary(self.spark.read.schema(RESULT).parquet(place))
        body = f"{found['rows']} {found['sum']}".encode()
        self.folder.write(f"commit-{number:012d}", body + f" {crc32c(body):08x}".encode())

    def flush(self) -> None:
        pass

    def committed(self) -> list[int]:
        """Numbers of the whole batches before the first torn one."""
        out, names = [], self.folder.names()
        for number in sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-")):
            if f"commit-{number:012d}" not in names:
                break
            rows, total, crc = (self.folder.read(f"commit-{number:012d}").decode("ascii", "replace") + "  ").split(" ")[:3]
            try:
                whole = crc == f"{crc32c(f'{rows} {total}'.encode()):08x}" and _summary(self._batch(number)) == {"rows": int(rows), "sum": int(total)}
            except (PySparkException, Py4JJavaError) as e:
                if isinstance(e, Py4JJavaError) and not unreadable(e):
                    raise
                whole = False
            if not whole:
                break
            out.append(number)
        return out

    def _batch(self, number: int) -> DataFrame:
        return self.spark.read.schema(RESULT).parquet(f"{self.folder.path}/batch-{number:012d}")

    def read_all(self) -> DataFrame:
        """batch, and the columns of RESULT, of all committed batches."""
        out = self.spark.createDataFrame([], "batch long, " + RESULT)
        numbers = self.committed()
        if not numbers:
            return out
        rows = self.spark.read.schema(RESULT).parquet(*(f"{self.folder.path}/batch-{n:012d}" for n in numbers))
        batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch-(\d+)/", 1).cast("long")
        return out.union(rows.select(batch.alias("batch"), *rows.columns))


def for_each_batch(sink: Sink) -> Callable[[DataFrame, int], None]:
    """A sink as the target of ``writeStream.foreachBatch``."""
    return lambda batch, number: sink.emit(batch, number)


def per_partition(factory: Callable[[int], Sink], partitions: int) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the rows (with p) of each partition go to the sink that ``factory`` made for it."""
    sinks = [factory(i) for i in range(partitions)]

    def emit(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for i, sink in enumerate(sinks):
                sink.emit(batch.where(F.col("p") == i), number)
        finally:
            batch.unpersist()

    return emit
