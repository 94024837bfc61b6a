"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoints import CheckpointStore
from tidemark.model import StreamConfig
from tidemark.operators import lateness, merge, partition, windows
from tidemark.queries import QUERIES
from tidemark.sources.generator import GeneratorConfig, generate, live_panes

HEADLINE = [
    "watermark_trajectory", "tumbling_sum_count", "sliding_sum_count", "hopping_gap", "late_drop_l0", "late_drop_lpos", "late_accepted", "emission_changelog",
    "run_stats", "merge_sources", "min_watermark_idle", "partition_assign", "pane_snapshot_at", "restore_equivalence",
]
SECOND = StreamConfig(1000, interval=100, disorder=500)


def generated(spark: SparkSession, keys: int, parts: int = 0):
    """One million generated records of ``keys`` keys, tumbling windows of a second, late records dropped."""
    stream = generate(spark, GeneratorConfig(records=1_000_000, keys=keys)).withColumnRenamed("event_time_ms", "e")
    pairs = lateness.accepted(stream, SECOND)
    return partition.partitioned_sum_count(pairs, parts, SECOND) if parts else windows.sum_count(pairs, SECOND)


def merged(spark: SparkSession, k: int, barriers: int = 0):
    """One million generated records in all from k sources, merged, with combined watermarks; aligned cuts where there are barriers."""
    parts = [generate(spark, GeneratorConfig(records=1_000_000 // k, keys=1000, step=k - i, seed=42 + 7919 * i)) for i in range(k)]
    rows = [f.select(F.lit(i).alias("src"), F.col("offset").alias("src_offset"), "key", "value", F.col("event_time_ms").alias("e")) for i, f in enumerate(parts)]
    sources = rows[0]
    for more in rows[1:]:
        sources = sources.union(more)
    if barriers:
        merge.cuts_with_gaps(sources, [barriers] * k, SECOND.interval).collect()
    stream = merge.merge_sources(sources, k, SECOND).withColumn("offset", F.col("merged_offset"))
    pairs = windows.assign_windows(merge.with_watermark(stream, merge.combined_watermark(sources, k, SECOND)), SECOND)
    return windows.sum_count(lateness.mark_dropped(pairs, SECOND).where(~F.col("dropped")), SECOND).agg(F.sum("count"))


def panes(spark: SparkSession, live: int):
    """Two million records into ``live`` panes of one window that never ends."""
    rows, _ = live_panes(spark, 2_000_000, live, 1000)
    config = StreamConfig(1 << 40, interval=1000, disorder=0)
    return windows.sum_count(windows.assign_windows(rows, config), config).agg(F.sum("count"))


def checkpointed(spark: SparkSession, root: str):
    """The partitioned run with a snapshot on disk at its end."""
    out = generated(spark, 1000, 4)
    store = CheckpointStore(spark, root)
    panes_ = out.select("key", F.col("window_start_ms").alias("s"), "sum", "count")
    store.write(1_000_000, 0, panes_, panes_.select("s", F.lit(False).alias("fired"), F.lit(False).alias("again")).distinct())
    return store.load_latest().panes.agg(F.sum("count"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(make) -> float:
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    def fold() -> None:
        return generated(spark, 1000).agg(F.sum("count"))

    timed(fold)  # the session warms up on what is timed next
    out, rates = {}, {}
    for name, make in {"generated_1m_1000_keys": fold, "generated_1m_partitioned_4": lambda: generated(spark, 1000, 4)}.items():
        runs = [timed(make) for _ in range(5)]
        out[name] = statistics.median(runs)
        rates[name] = [round(1_000_000 / x) for x in (max(runs), statistics.median(runs), min(runs))]
    more = {f"merge_k{k}": (lambda k=k: merged(spark, k)) for k in (1, 2, 3)}
    more |= {"merge_k2_aligned": lambda: merged(spark, 2, 100_000), "live_panes_20000": lambda: panes(spark, 20_000), "checkpoint_written_and_loaded": lambda: checkpointed(spark, tempfile.mkdtemp(prefix="tidemark-"))}
    for name, make in more.items():
        runs = [timed(make) for _ in range(3)]
        out[name] = statistics.median(runs)
        rates[name] = [round((2_000_000 if "panes" in name else 1_000_000) / x) for x in (max(runs), statistics.median(runs), min(runs))]
    for name in HEADLINE:
        out[name] = timed(lambda name=name: QUERIES[name](spark, sf))
    print(json.dumps({"metric": "total_query_time", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": sf.rstrip("/").rpartition("sf")[2], "records_per_second_min_median_max": rates, "cpus": cpus}))


if __name__ == "__main__":
    main()
