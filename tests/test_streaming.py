"""Streams against the batch plan."""

from pyspark.sql import functions as F

from tidemark.model import StreamConfig
from tidemark.operators import lateness, watermark, windows
from tidemark.sinks import DurableSink, for_each_batch
from tidemark.sources.generator import GeneratorConfig, generate
from tidemark.streaming import engine


def by_window(rows):
    return {(r.key, r.window_start_ms): (r["sum"], r["count"]) for r in rows}


def test_append_mode_matches_batch(spark, tmp_path):
    c = StreamConfig(1000, disorder=500)
    stream = generate(spark, GeneratorConfig(records=3000, step=5)).select("key", "value", F.col("event_time_ms").alias("e"))
    stream.coalesce(1).write.parquet(str(tmp_path / "in/a"))
    # A record far ahead stands for the final flush, which streams don't have.
    spark.createDataFrame([("flush", 0, 10**9)], "key string, value long, e long").write.parquet(str(tmp_path / "in/b"))
    live = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    sink = DurableSink(spark, str(tmp_path / "out"))
    query = engine.append_windows(live, c).writeStream.foreachBatch(for_each_batch(sink)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = by_window(r for r in sink.read_all().collect() if r.key != "flush")
    want = by_window(windows.sum_count(windows.assign_windows(stream.withColumn("offset", F.lit(1)), c), c).collect())
    assert got == want


def test_exact_lateness_matches_batch(spark, tmp_path):
    c = StreamConfig(1000, lateness=2000, interval=50, disorder=500)
    stream = generate(spark, GeneratorConfig(records=1000, step=10, late_fraction=0.1)).withColumnRenamed("event_time_ms", "e")
    wms = watermark.trajectory(stream, c)
    rows = engine.annotated(stream, wms, c, partitions=2)
    for i, part in enumerate((rows.where("offset <= 1001"), rows.where("offset > 1001"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    live = spark.readStream.schema(engine.ANNOTATED).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = engine.exact_windows(live, c).writeStream.format("memory").queryName("exact").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    emitted = spark.table("exact").collect()
    best = {}
    for r in emitted:
        k = (r.key, r.window_start_ms)
        best[k] = max(best.get(k, (0, 0)), (r["count"], r["sum"]))
    want = by_window(windows.sum_count(lateness.accepted(stream, c), c).collect())
    assert {k: (s, n) for k, (n, s) in best.items()} == want
    assert any(r.kind == "refire" for r in emitted)
