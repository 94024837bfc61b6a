"""Window assignment: tumbling, sliding, and hopping with gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import StreamConfig


def window_starts(e: Column, config: StreamConfig) -> Column:
    """All starts s >= 0, multiples of the step, with s <= e < s + size (none in the gaps of a wide step)."""
    last = F.floor(e / config.step) * config.step
    first = F.greatest(F.lit(0), (F.floor((e - config.size) / config.step) + 1) * config.step)
    return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.lit(config.step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def assign_windows(stream: DataFrame, config: StreamConfig) -> DataFrame:
    """A row for each record and window (s)."""
    if config.step == config.size:
        return stream.withColumn("s", (F.floor(F.col("e") / config.size) * config.size).cast("long"))
    return stream.withColumn("s", F.explode(window_starts(F.col("e"), config)))


def sum_count(pairs: DataFrame, config: StreamConfig) -> DataFrame:
    """key, window_start_ms, window_end_ms, sum, count."""
    out = pairs.groupBy("key", "s").agg(F.sum("value").alias("sum"), F.count("*").alias("count"))
    return out.select("key", F.col("s").alias("window_start_ms"), (F.col("s") + config.size).alias("window_end_ms"), "sum", "count")
