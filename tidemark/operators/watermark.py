"""The watermark trajectory of a bounded stream, and the watermark in force at each record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import broadcast_if_small, estimated_bytes, running_max
from tidemark.model import StreamConfig


def trajectory(stream: DataFrame, config: StreamConfig) -> DataFrame:
    """j, wm, before (the watermark of j - 1): one row for each complete interval of records."""
    i = config.interval
    tops = stream.groupBy(F.floor((F.col("offset") - 1) / i + 1).alias("j")).agg(F.max("e").alias("top"), F.count("*").alias("n"))
    out = running_max(tops.where(F.col("n") == i).select("j", "top"), "j", "top")
    wm = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0), F.col(c) - config.disorder)).cast("long")
    return out.select("j", wm("upto").alias("wm"), wm("before").alias("before"))


def advances(wms: DataFrame) -> DataFrame:
    """The rows (j, wm) at which the watermark strictly rises; the first always does."""
    return wms.where("before is null or wm > before").select("j", "wm")


def in_force(stream: DataFrame, wms: DataFrame, config: StreamConfig) -> DataFrame:
    """``stream`` with slot (complete intervals before the record) and wm_in (null before the first watermark).

    There is a watermark for each ``interval`` records, so its table's size follows from the stream's.
    """
    rows = stream.withColumn("slot", F.floor((F.col("offset") - 1) / config.interval))
    table = wms.select(F.col("j").alias("slot"), F.col("wm").alias("wm_in"))
    return rows.join(broadcast_if_small(table, estimated_bytes(stream) / config.interval), "slot", "left")


def output_watermark(partitions: DataFrame) -> DataFrame:
    """wm: the least watermark over all partitions (p, wm), null while one of them has none. One row."""
    last = partitions.groupBy("p").agg(F.max("wm").alias("wm"))
    return last.agg(F.when(F.count("wm") == F.count("*"), F.min("wm")).alias("wm"))
