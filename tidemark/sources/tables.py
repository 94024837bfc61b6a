"""Tables as streams: records in arrival order, stopping, seeking, and splitting into several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import dense_offsets, time_buckets
from tidemark.model import HOUR


def event_stream(spark: SparkSession, sf_dir: str, delayed: bool = True) -> DataFrame:
    """The ``events`` table as a disordered stream: offset, key, value, e, event_id.

    Every tenth event arrives up to 50 hours after its time, the others up to an hour. Arrival is bucketed by hours.
    """
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    e = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    i = F.col("event_id")
    delay = F.when(i % 10 == 3, (i * 7919 % 1009) * 180_000).otherwise((i * 104_729 % 1013) * 3500) if delayed else F.lit(0)
    rows = rows.select(
        "event_id",
        F.concat(F.lit("key-"), F.lpad((F.col("user_id") % 10).cast("string"), 4, "0")).alias("key"),
        F.round(F.col("value") * 100).cast("long").alias("value"),
        e.cast("long").alias("e"),
        (e + delay).cast("long").alias("arrival"),
    )
    rows, bucket = time_buckets(rows, "arrival", HOUR)
    return dense_offsets(rows, bucket, [F.col("arrival"), F.col("event_id")]).drop("arrival", "_bucket")


def stop_at(stream: DataFrame, records: int) -> DataFrame:
    """The first ``records`` records."""
    return stream.where(F.col("offset") <= records)


def seek(stream: DataFrame, offset: int) -> DataFrame:
    """The records after ``offset``; offsets stay absolute, so control records keep their places."""
    return stream.where(F.col("offset") > offset)


def split_sources(stream: DataFrame, k: int) -> DataFrame:
    """``stream`` as k sources by event_id % k, with src, src_offset; source i's times run k - i times as fast."""
    start = stream.agg(F.min("e")).first()[0] or 0
    rows = stream.withColumn("src", (F.col("event_id") % k).cast("int"))
    rows = rows.withColumn("e", F.lit(start) + (F.col("e") - start) * (k - F.col("src")))
    # Dense within each source, in the order of the whole stream.
    rows = rows.withColumn("block", F.floor(F.col("offset") / 65_536))
    counts = rows.groupBy("block").pivot("src", list(range(k))).count().na.fill(0)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("block", *(F.coalesce(F.sum(str(i)).over(before), F.lit(0)).alias(f"before_{i}") for i in range(k)))
    within = F.row_number().over(Window.partitionBy("block", "src").orderBy("offset"))
    base = F.element_at(F.array(*(F.col(f"before_{i}") for i in range(k))), F.col("src") + 1)
    out = rows.join(counts, "block").withColumn("src_offset", (base + within).cast("long"))
    return out.drop("block", *(f"before_{i}" for i in range(k)))
