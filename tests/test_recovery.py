"""Snapshots, sinks, streaming sources and killed drivers."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import checkpoints, nemesis, oracle, sinks
from tidemark.model import StreamConfig
from tidemark.operators import merge
from tidemark.operators.watermark import output_watermark
from tidemark.sources.generator import GeneratorConfig, generate, live_panes, record
from tidemark.streaming import engine, source

PANES = [("a", 0, 5, 2), ("b", 0, 7, 1), ("", 1000, -3, 1)]


@pytest.fixture
def store(spark, tmp_path):
    return checkpoints.CheckpointStore(spark, f"file://{tmp_path}/ck")


def fill(spark, store, *offsets, version=2):
    panes = spark.createDataFrame(PANES, checkpoints.PANES)
    marks = spark.createDataFrame([(0, True, True), (1000, False, False)], checkpoints.WINDOWS)
    for o in offsets:
        store.write(o, o * 10, panes, marks, version)


def test_snapshots_round_trip_and_retention(spark, store):
    assert store.load_latest() is None and store.valid_offsets() == []
    fill(spark, store, 100, 200, 300)
    assert store.listed() == store.valid_offsets() == [200, 300]
    got = store.load(300)
    assert (got.offset, got.watermark) == (300, 3000)
    assert sorted(map(tuple, got.panes.collect())) == sorted(PANES)
    assert sorted(map(tuple, got.windows.collect())) == [(0, True, True), (1000, False, False)]
    assert store.load(100) is None
    fill(spark, store, 400, version=1)
    assert store.load(400).windows.count() == 0
    with pytest.raises(ValueError, match="unknown"):
        fill(spark, store, 500, version=3)


def test_torn_and_damaged_snapshots_are_passed_over(spark, store, tmp_path):
    fill(spark, store, 100, 200)
    (tmp_path / "ck/.tmp-300-x").mkdir()
    manifest = tmp_path / "ck/checkpoint-200/manifest"
    data = bytearray(manifest.read_bytes())
    data[5] ^= 1
    manifest.write_bytes(bytes(data))
    (tmp_path / "ck/checkpoint-200/.manifest.crc").unlink()
    assert store.valid_offsets() == [100] and (tmp_path / "ck/.tmp-300-x").exists()
    assert store.load_latest().offset == 100 and not (tmp_path / "ck/.tmp-300-x").exists()
    for f in (tmp_path / "ck/checkpoint-100/panes").glob("*.parquet"):
        f.write_bytes(f.read_bytes()[:40])
    assert store.load_latest() is None


def test_sets_of_partitions(spark, tmp_path):
    stores = checkpoints.partition_stores(spark, f"file://{tmp_path}", 2)
    assert checkpoints.load_complete(stores) is None
    fill(spark, stores[0], 100, 200)
    fill(spark, stores[1], 100)
    assert [s.offset for s in checkpoints.load_complete(stores)] == [100, 100]
    assert sorted(map(tuple, checkpoints.checkpoint_files(spark, stores).collect())) == [(0, 100), (0, 200), (1, 100)]


def test_sinks(spark, tmp_path, capsys):
    rows = spark.createDataFrame([("k", 0, 1000, 6, 3)], sinks.RESULT)
    memory = sinks.MemorySink()
    for n in (1, 0, 1):
        memory.emit(rows, n)
    assert [r["sum"] for r in memory.rows] == [6, 6]
    memory.clear()
    assert memory.rows == []
    out = sinks.StdoutSink()
    out.emit(rows, 0)
    out.flush()
    assert "window=[0, 1000) key=k sum=6 count=3" in capsys.readouterr().out
    durable = sinks.DurableSink(spark, f"file://{tmp_path}/out")
    assert durable.read_all().count() == 0
    for n in range(3):
        durable.emit(rows.withColumn("sum", F.lit(n).cast("long")), n)
    durable.emit(rows, 1)  # again, with another result
    assert sorted((r.batch, r["sum"]) for r in durable.read_all().collect()) == [(0, 0), (1, 6), (2, 2)]
    (tmp_path / "out/commit-000000000002").unlink()
    assert durable.committed() == [0, 1]
    for f in (tmp_path / "out/batch-000000000001").glob("*.parquet"):
        f.unlink()
    assert durable.committed() == [0]
    parts = {}
    emit = sinks.per_partition(lambda i: parts.setdefault(i, sinks.MemorySink()), 2)
    emit(rows.withColumn("p", F.lit(1)), 0)
    assert len(parts[1].rows) == 1 and parts[0].rows == []


def test_records_repeat_the_generator(spark):
    c = GeneratorConfig(records=200, late_fraction=0.3, seed=9)
    assert [tuple(r) for r in generate(spark, c).orderBy("offset").collect()] == [record(c, o) for o in range(1, 201)]
    rows, wms = live_panes(spark, 1000, 50, 100)
    assert rows.select("key").distinct().count() == 50 and wms.count() == 10


def test_stream_source_admits_seeks_and_restarts(spark, tmp_path):
    source.register(spark)

    def run(name, **options):
        rows = spark.readStream.format("tidemark_records").options(records=250, batch=100, split=30, **options).load()
        seen = {}
        query = rows.writeStream.foreachBatch(lambda b, n: seen.setdefault(n, [r.offset for r in b.orderBy("offset").collect()])).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            for _ in range(600):
                if sum(map(len, seen.values())) >= 250 - int(options.get("start", 0)) or query.exception():
                    break
                query.awaitTermination(0.1)
        finally:
            query.stop()
        return [seen[n] for n in sorted(seen)]

    assert run("a") == [list(range(1, 101)), list(range(101, 201)), list(range(201, 251))]
    assert run("b", start=120) == [list(range(121, 221)), list(range(221, 251))]
    script = source.Stopping(source.Scripted([("a", 1, 10), ("b", 2, 20), ("c", 3, 30)]), 2)
    assert script.end() == 2 and list(script.read(0, 3)) == [(1, "a", 1, 10, 10), (2, "b", 2, 20, 20)]
    flushed = source.Flushed(script)
    assert [r[1] for r in flushed.read(1, 3)] == ["b", "flush"]


def test_state_is_read_back(spark, tmp_path):
    c = StreamConfig(1000, lateness=2000, interval=50, disorder=500)
    rows = spark.createDataFrame([(0, 1, "a", 5, 100, None), (0, 2, "b", 7, 200, None), (0, 3, "a", 1, 300, None), (0, 5, None, None, None, 50)], engine.ANNOTATED)
    rows.coalesce(1).write.parquet(str(tmp_path / "in/0"))
    live = spark.readStream.schema(engine.ANNOTATED).parquet(str(tmp_path / "in/*"))
    query = engine.exact_windows(live, c).writeStream.format("memory").queryName("state").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = engine.state_rows(spark, str(tmp_path / "ck")).collect()
    assert sorted((r.user_map_value["key"], r.user_map_value["sum"], r.user_map_value["count"]) for r in got) == [("a", 6, 2), ("b", 7, 1)]


def test_output_watermark(spark):
    rows = lambda *x: spark.createDataFrame(x, "p int, wm long")
    assert output_watermark(rows((0, 5), (0, 9), (1, 7))).first().wm == 7
    assert output_watermark(rows((0, 5), (1, None))).first().wm is None


def test_alignment_against_a_merge_turn_by_turn():
    cuts = 0
    for seed in range(400):
        r = random.Random(seed)
        k, interval, timeout = r.randint(1, 4), r.choice([3, 4, 10]), r.randint(1, 9)
        totals = [r.randint(0, 60) for _ in range(k)]
        barriers = [r.choice([0, 3, 5, 7, 10]) if r.random() < 0.2 else r.choice([3, 5, 7, 10]) for _ in range(k)]
        spans = [sorted({r.randint(0, 50): r.randint(1, 30) for _ in range(r.randint(0, 2))}.items()) for _ in range(k)]
        config = StreamConfig(10, interval=interval, disorder=2)
        _, _, want = oracle.merge([[(j, "k", 1, j) for j in range(n)] for n in totals], config, spans, timeout, barriers)
        idle = tuple(merge.IdleSpan(i, a, b, timeout) for i, x in enumerate(spans) for a, b in x if a <= totals[i])
        assert merge.align(totals, barriers, interval, idle) == want, seed
        cuts += len(want)
    assert cuts > 1000
    # An idle source does not hold the others up, and both are read to their ends.
    assert len(merge.align([6000, 6000], [100, 100], 100, (merge.IdleSpan(1, 150, 2000, 30),))) >= 60


@pytest.mark.parametrize("tear", [False, True])
def test_a_killed_stream_loses_nothing(spark, tmp_path, tear):
    report = nemesis.kill_and_recover(spark, str(tmp_path), records=1500, tear=tear)
    assert report.genuine and report.passed and report.killed >= 2
