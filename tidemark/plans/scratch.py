"""Frames that several others build on, written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; unset, a temporary one if driver and executors are one machine, else an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        root = _own[0]
    return root.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder; deleted with ``clear`` or when the driver ends."""
    path = f"{scratch_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a scratch table, read again."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Delete all scratch tables made so far; frames that read them are of no use any more."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):  # the driver's JVM may be gone; the cluster's own cleaning is the last resort
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


atexit.register(clear)
