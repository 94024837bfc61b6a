"""Helpers that the training-data operators share: scratch tables, UTF-8 buffers and hashing.

Scratch tables go to the folder that ``spark.checkpoint.dir`` names, since executors and the
driver share only that; where it is unset and all is one machine (tests), a temporary folder of this session is used.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch data, without a trailing slash."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_root:
            _own_root.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        root = _own_root[0]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, rows: int | None = None, per_file: int = 100_000) -> DataFrame:
    """Write ``df`` as a scratch table and read it again: cuts the lineage, survives lost executors.

    rows: how many it has at most, where that is known: small tables are written as few files of ``per_file`` rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that ``materialise`` made and nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULT_BYTES = "67108864b"


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, batch: str = "8m") -> DataFrame:
    """``df.mapInArrow`` with batches of ``batch`` bytes (unless the session says otherwise), after which a worker gives back its memory."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, _DEFAULT_BYTES) == _DEFAULT_BYTES:
        conf.set(_BATCH_BYTES, batch)

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(frugal, schema)


def _give_back() -> None:
    """Workers stay when a task ends: hand what it freed to the system, so that tasks of other stages have it."""
    _powers.shrink()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A pseudo-random 64-bit value for each byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.shrink()

    def shrink(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


_powers = Powers()


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64 with a leading zero, for ``span_hash``."""
    _powers.reach(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers.up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], equal for equal content wherever it stands."""
    return mix64((prefix[end] - prefix[start]) * _powers.down[start] + (end - start).astype(np.uint64))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that tell rows apart even where ids are null or repeat: k (the id) and th (a hash of the text).

    Rows equal in both are exact copies of each other and get equal results everywhere.
    """
    return [
        F.coalesce(F.col(doc_id), F.lit(-(2**63))).cast("long").alias("k"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"),
    ]


def prefix_sums(rows: DataFrame, group: list[str], order: Column, sums: dict[str, Column | str]) -> DataFrame:
    """``rows`` with, for each (new name: value), the sum of the values before a row of its group in the ascending order of ``order``.

    order: a 64-bit hash; rows of equal hashes are ordered by all their columns. Two levels, so no task holds a whole group: buckets
    of hashes are summed first (4096 for each group at most) and rows are ordered inside their bucket.
    """
    names = rows.columns
    rows = rows.withColumn("_o", order).withColumn("_b", F.shiftright("_o", 52)).withColumns({f"_v{i}": F.lit(1) if v == 1 else F.col(v) if isinstance(v, str) else v for i, v in enumerate(sums.values())})
    totals = rows.groupBy(*group, "_b").agg(*(F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))))
    upto = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_b", *(F.coalesce(F.sum(f"_t{i}").over(upto), F.lit(0)).alias(f"_p{i}") for i in range(len(sums))))
    inside = Window.partitionBy(*group, "_b").orderBy("_o", *names).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_i{i}": F.coalesce(F.sum(f"_v{i}").over(inside), F.lit(0)) for i in range(len(sums))})
    out = rows.join(totals, [*group, "_b"])
    return out.select(*names, *((F.col(f"_p{i}") + F.col(f"_i{i}")).alias(name) for i, name in enumerate(sums)))


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): a row (node, root) for each node of an edge, root the least node.

    Alternates large-star and small-star steps until nothing changes, which takes a number of rounds logarithmic in the
    nodes; each round is a table in the shared folder, nothing is collected but two sums that tell whether the edges have
    changed. rows: how many edges there are at most.
    """
    def summary(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e, "edges", rows)
    state, now = None, summary(e)
    while now != state and now[0]:
        state = now
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        old, e = e, materialise(small.union(down.select("a", F.col("m").alias("b"))).distinct(), "edges", 2 * state[0])
        now = summary(e)
        discard(old)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def release(spark: SparkSession) -> None:
    """Let the JVM drop the shuffle files of plans that nothing refers to any more, so they don't add up on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
