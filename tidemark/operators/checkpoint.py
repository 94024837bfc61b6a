"""Snapshots of window state, complete checkpoints, restoring, and at-least-once unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import StreamConfig


def barriers(stream: DataFrame, every: int) -> DataFrame:
    """epoch, cut_offset of the barriers after each ``every`` records."""
    last = stream.agg(F.max("offset").alias("n"))
    return last.where(F.col("n") >= every).select(F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / every))).alias("epoch")).select(F.col("epoch").cast("long"), (F.col("epoch") * every).cast("long").alias("cut_offset"))


def panes_at(pairs: DataFrame, fires: DataFrame, wms: DataFrame, offset: int, config: StreamConfig) -> DataFrame:
    """key, s, sum, count, fired: live state after ``offset`` records (a multiple of the interval).

    A window leaves the state when it fires without allowed lateness, else when the watermark reaches its end and that.
    """
    j = offset // config.interval
    wm = wms.where(F.col("j") == j).select(F.col("wm").alias("now"))
    state = fires.select("s", (F.col("fire") <= j).alias("fired"))
    if config.lateness:
        done = F.col("fired") & (F.col("now") >= F.col("s") + config.size + config.lateness)
    else:
        done = F.col("fired")
    live = state.join(F.broadcast(wm), how="left").where(~F.coalesce(done, F.lit(False))).select("s", "fired")  # one row
    parts = pairs.where(F.col("offset") <= offset).groupBy("key", "s").agg(F.sum("value").alias("sum"), F.count("*").alias("count"))
    return parts.join(live, "s")


def window_marks(panes: DataFrame, late: DataFrame, offset: int, config: StreamConfig) -> DataFrame:
    """s, fired, again: the windows of ``panes``, and whether a late record accepted up to ``offset`` still waits to be emitted."""
    due = late.where((F.col("offset") <= offset) & (F.col("refire") > offset // config.interval)).select("s", F.lit(True).alias("again")).distinct()
    return panes.select("s", "fired").distinct().join(due, "s", "left").select("s", "fired", F.coalesce("again", F.lit(False)).alias("again"))


def restore(pairs: DataFrame, panes: DataFrame, log: DataFrame, offset: int, config: StreamConfig) -> DataFrame:
    """Results of a run restored from ``panes`` at ``offset`` and replayed after it; windows gone by then keep what was emitted."""
    replay = pairs.where(F.col("offset") > offset).select("key", "s", F.col("value").alias("sum"), F.lit(1).cast("long").alias("count"))
    now = panes.select("key", "s", "sum", "count").unionByName(replay).groupBy("key", "s").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    gone = log.where(F.col("at") <= offset // config.interval).groupBy("key", "s").agg(F.max(F.struct("count", "sum")).alias("r"))
    gone = gone.join(now, ["key", "s"], "left_anti").select("key", "s", F.col("r.sum").alias("sum"), F.col("r.count").alias("count"))
    out = now.unionByName(gone)
    return out.select("key", F.col("s").alias("window_start_ms"), (F.col("s") + config.size).alias("window_end_ms"), "sum", "count")


def recovery_union(log: DataFrame, restored: int, crashed: int, config: StreamConfig) -> DataFrame:
    """Results and duplicates of a run that crashed after slot ``crashed`` and went on from slot ``restored``: the last writer wins."""
    first = log.where(F.col("at") <= crashed).withColumn("run", F.lit(1))
    second = log.where(F.col("at") > restored).withColumn("run", F.lit(2))
    both = first.unionByName(second).groupBy("key", "s").agg(F.max(F.struct("run", "at", "count", "sum")).alias("r"), (F.count("*") - 1).alias("duplicates"))
    return both.select("key", F.col("s").alias("window_start_ms"), (F.col("s") + config.size).alias("window_end_ms"), F.col("r.sum").alias("sum"), F.col("r.count").alias("count"), "duplicates")


def highest_complete(files: DataFrame, partitions: int) -> DataFrame:
    """offset: the greatest that all partitions have a checkpoint of (null if there is none). files: (partition, offset)."""
    whole = files.groupBy("offset").agg(F.countDistinct("partition").alias("n")).where(F.col("n") == partitions)
    return whole.agg(F.max("offset").alias("offset"))


def highest_partial(files: DataFrame) -> DataFrame:
    """offset: the greatest that any partition has."""
    return files.agg(F.max("offset").alias("offset"))
