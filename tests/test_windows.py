"""Golden cases and invariants of the window engine."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ordered
from tidemark.functions.hashing import crc32c, fnv1a, fnv1a_column, unsigned_mod
from tidemark.model import StreamConfig
from tidemark.operators import emissions, lateness, merge, partition, watermark, windows
from tidemark.sources.generator import GeneratorConfig, generate

SCHEMA = "offset long, key string, value long, e long"


def starts(spark, e, size, slide):
    row = spark.createDataFrame([(e,)], "e long").select(windows.window_starts(F.col("e"), StreamConfig(size, slide=slide)).alias("s")).first()
    return row.s


@pytest.mark.parametrize(
    ("e", "size", "slide", "want"),
    [
        (999, 1000, 0, [0]), (1000, 1000, 0, [1000]), (0, 1000, 0, [0]), (7000, 10000, 5000, [0, 5000]), (0, 10000, 5000, [0]), (5000, 10000, 5000, [0, 5000]),
        (95000, 10000, 5000, [90000, 95000]), (15000, 10000, 2000, [6000, 8000, 10000, 12000, 14000]), (700, 500, 800, []), (850, 500, 800, [800]),
    ],
)
def test_window_starts(spark, e, size, slide, want):
    assert starts(spark, e, size, slide) == want


def results(frame):
    return sorted((r.window_start_ms, r.key, r["sum"], r["count"]) for r in frame.collect())


def test_golden_tumbling_and_sliding(spark):
    rows = spark.createDataFrame([(1, "A", 10, 500), (2, "B", 20, 1500), (3, "A", 30, 200)], SCHEMA)
    c = StreamConfig(1000)
    assert results(windows.sum_count(windows.assign_windows(rows, c), c)) == [(0, "A", 40, 2), (1000, "B", 20, 1)]
    rows = spark.createDataFrame([(1, "X", 100, 1500)], SCHEMA)
    c = StreamConfig(2000, slide=1000)
    assert results(windows.sum_count(windows.assign_windows(rows, c), c)) == [(0, "X", 100, 1), (1000, "X", 100, 1)]


def simulate(rows, c):
    """Record by record: emissions (slot, kind, key, s, sum, count), dropped and late offsets."""
    panes, fired, again, log, dropped, late = {}, set(), set(), [], set(), set()
    wm, top = None, 0

    def emit(slot, kind, s):
        log.extend((slot, kind, k, s, *v) for (w, k), v in panes.items() if w == s)

    for o, k, v, e in rows:
        s = max(0, ((e - c.size) // c.step + 1) * c.step)
        for s in range(s, e // c.step * c.step + 1, c.step):
            if wm is not None and wm >= s + c.size + c.lateness:
                dropped.add(o)
                continue
            if s in fired:
                again.add(s)
                late.add(o)
            old = panes.get((s, k), (0, 0))
            panes[s, k] = (old[0] + v, old[1] + 1)
        top = max(top, e)
        if o % c.interval == 0:
            new = max(0, top - c.disorder)
            if wm is None or new > wm:
                wm = new
                for s in {w for w, _ in panes} - fired:
                    if s + c.size <= wm:
                        emit(o // c.interval, "fire", s)
                        fired.add(s)
                for s in again:
                    emit(o // c.interval, "refire", s)
                again = set()
    for s in again:
        emit(-1, "refire", s)
    for s in {w for w, _ in panes} - fired:
        emit(-1, "fire", s)
    return sorted(log), dropped, late


@pytest.mark.parametrize("late", [0.0, 0.1])
@pytest.mark.parametrize("config", [StreamConfig(1000, interval=20, disorder=500), StreamConfig(2000, slide=700, lateness=2000, interval=20, disorder=500)])
def test_changelog_against_simulation(spark, config, late):
    stream = generate(spark, GeneratorConfig(records=1500, keys=4, step=10, late_fraction=late, seed=3)).withColumnRenamed("event_time_ms", "e").cache()
    rows = [(r.offset, r.key, r.value, r.e) for r in stream.orderBy("offset").collect()]
    want, dropped, accepted = simulate(rows, config)
    wms = watermark.trajectory(stream, config)
    adv = watermark.advances(wms)
    judged = lateness.classify(stream, wms, config).cache()
    pairs = judged.where(~F.col("dropped"))
    fires = emissions.first_fires(pairs, adv, config).cache()
    again = emissions.late_accepted(pairs, fires, adv).cache()
    log = emissions.changelog(pairs, emissions.emission_slots(fires, again), config)
    got = sorted((r.slot, r.kind, r.key, r.s, r["sum"], r["count"]) for r in log.withColumn("slot", emissions.shown("at")).collect())
    assert got == want
    assert {r.offset for r in judged.where("dropped").collect()} == dropped
    assert {r.offset for r in again.collect()} == accepted
    assert bool(dropped) == (late > 0)


def test_bounded_disorder_drops_nothing(spark):
    stream = generate(spark, GeneratorConfig(records=2000)).withColumnRenamed("event_time_ms", "e")
    c = StreamConfig(1000, interval=50, disorder=500)
    out = lateness.classify(stream, watermark.trajectory(stream, c), c)
    assert out.where("dropped").count() == 0


def test_generator_seeks_and_repeats(spark):
    c = GeneratorConfig(records=500, late_fraction=0.2)
    whole = generate(spark, c).where("offset > 200").collect()
    assert whole == generate(spark, c, start=200).collect()
    assert all(1 <= r.value <= 1000 and r.event_time_ms >= 0 for r in whole)


def test_hashes(spark):
    assert [fnv1a(x) for x in (b"", b"a", b"foobar")] == [14695981039346656037, 12638187200555641996, 9625390261332436968]
    assert crc32c(b"123456789") == 0xE3069283
    words = ["", "a", "foobar", "key-0001", "é"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fnv1a_column(F.col("w")).alias("h"), unsigned_mod(fnv1a_column(F.col("w")), 7).alias("m")).collect()
    assert all(r.h % (1 << 64) == fnv1a(r.w.encode()) and r.m == fnv1a(r.w.encode()) % 7 for r in rows)


def test_aligned_cuts_from_counts():
    assert merge.align([2000, 6000], [100, 300], 0) == [400 * n for n in range(1, 21)]
    assert merge.align([6000, 6000], [50, 5000])[0] == 5050
    assert merge.align([5000], [1000]) == [1000, 2000, 3000, 4000, 5000]


def test_busy_spans_are_cut_finer(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("t"), "id")
    for limits in ({}, {"least_bytes": 0, "most_rows": 100}):
        cut, bucket = ordered.time_buckets(rows, "t", 1000, **limits)
        out = ordered.dense_offsets(cut, bucket, [F.col("t"), F.col("id")])
        assert [r.t for r in out.orderBy("offset").collect()] == list(range(3000))
        assert cut.select(bucket).distinct().count() == (30 if limits else 3)


def test_a_filter_by_partition_hashes_no_rows(spark, tmp_path):
    spark.range(100).select(F.concat(F.lit("k"), F.col("id") % 10).alias("key"), F.col("id").alias("value")).write.parquet(str(tmp_path / "rows"))
    sums = spark.read.parquet(str(tmp_path / "rows")).groupBy("key").agg(F.sum("value").alias("sum"))
    for part in (0, 1):
        own = partition.with_partition(sums, 2).where(F.col("p") == part)
        assert sorted(map(tuple, own.collect())) == [(k, 450 + 10 * i, part) for i in range(10) if fnv1a((k := f"k{i}").encode()) % 2 == part]
        below = re.findall(r"Filter .*aggregate\(.*\n\W*(\w+)", own._jdf.queryExecution().optimizedPlan().toString())
        assert below == ["Aggregate"]
