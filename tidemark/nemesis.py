"""Proof by killing: a stream's driver is killed for good, restarted, and must have lost nothing.

A child process runs a windowed stream from ``tidemark_records`` into a ``DurableSink``. The parent watches the query's
logs, sends SIGKILL in the middle of a batch or between two, may tear the last batch that the sink had committed, starts
the child again, and holds the union of all that was emitted against the oracle.
"""

from __future__ import annotations

import os
import signal
import subprocess
import sys
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark import oracle
from tidemark.model import StreamConfig
from tidemark.sinks import DurableSink, for_each_batch
from tidemark.sources.generator import GeneratorConfig, record
from tidemark.streaming import engine, source

CONFIG = StreamConfig(1000, interval=100, disorder=500)


def child(folder: str, records: int, batch: int, seed: int, pause: float) -> None:
    """Run the stream to its end. pause: seconds that each batch waits inside the sink, so that a kill can fall there."""
    spark = session()
    source.register(spark)
    spark.streams.addListener(source.ProgressProbe(f"{folder}/progress.json"))
    rows = spark.readStream.format("tidemark_records").options(records=records, batch=batch, seed=seed, step=10, flush="true").load()
    rows = rows.select("key", "value", F.col("event_time_ms").alias("e"))
    emit = for_each_batch(DurableSink(spark, f"{folder}/out"))

    def slow(frame, number: int) -> None:
        time.sleep(pause)
        emit(frame, number)

    query = engine.append_windows(rows, CONFIG).writeStream.foreachBatch(slow).option("checkpointLocation", f"{folder}/log").start()
    while not query.exception() and not _drained(query, records + 1):
        time.sleep(0.1)
    query.stop()
    if query.exception():
        raise query.exception()
    Path(f"{folder}/done").touch()


def _drained(query, end: int) -> bool:
    """Whether a batch without records has followed the one that read the last record: what that one closed is out then."""
    p = query.lastProgress
    return bool(p) and p["sources"][0]["endOffset"] is not None and f"{end}" in str(p["sources"][0]["endOffset"]) and not query.status["isDataAvailable"] and not query.status["isTriggerActive"]


def session() -> SparkSession:
    out = (
        SparkSession.builder.master("local[2]").appName("tidemark").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    return out


def _numbers(folder: Path) -> list[int]:
    return sorted(int(f.name) for f in folder.glob("[0-9]*")) if folder.is_dir() else []


@dataclass(frozen=True)
class Report:
    """killed: batches committed at the kill. genuine: it fell inside a batch, as the logs show (offsets without a commit)."""

    killed: int
    genuine: bool
    torn: bool
    missing: int
    wrong: int
    duplicates: int

    @property
    def passed(self) -> bool:
        return self.missing == 0 and self.wrong == 0


def kill_and_recover(spark: SparkSession, folder: str, records: int = 4000, batch: int = 500, seed: int = 42, after: int = 2, inside: bool = True, tear: bool = False, wait: float = 180.0) -> Report:
    """One run: kill after ``after`` commits (``inside`` the next batch or before it), recover, compare with the oracle."""
    place = Path(folder)
    place.mkdir(parents=True, exist_ok=True)
    command = [sys.executable, "-m", "tidemark.nemesis", folder, str(records), str(batch), str(seed)]
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(Path(__file__).parents[1]), os.environ.get("PYTHONPATH", "")])}
    first = subprocess.Popen([*command, "1.0"], env=env, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    end = time.time() + wait
    try:
        while True:
            if time.time() > end or first.poll() is not None:
                raise RuntimeError("the stream did not get to the kill")
            commits, offsets = _numbers(place / "log/commits"), _numbers(place / "log/offsets")
            if len(commits) >= after and (len(offsets) > len(commits)) == inside:
                break
            time.sleep(0.02)
    finally:
        if first.poll() is None:
            os.killpg(first.pid, signal.SIGKILL)  # the process group that this call made: the child, its JVM and workers
        first.wait()
    commits, offsets = _numbers(place / "log/commits"), _numbers(place / "log/offsets")
    before = DurableSink(spark, f"{folder}/out")
    if tear and before.committed():
        last = before.committed()[-1]
        for f in (place / f"out/batch-{last:012d}").glob("*.parquet"):
            f.write_bytes(f.read_bytes()[: f.stat().st_size // 2])
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
        # The stream's own log must not be ahead of the sink's whole batches.
        for kind in ("commits", "offsets"):
            for n in _numbers(place / "log" / kind):
                if n >= last + (kind == "offsets"):
                    (place / "log" / kind / str(n)).unlink()
                    (place / "log" / kind / f".{n}.crc").unlink(missing_ok=True)
    subprocess.run([*command, "0"], env=env, check=True, timeout=wait, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    rows = [r for r in before.read_all().collect() if r.key != "flush"]
    got: dict[tuple[str, int], tuple[int, int]] = {}
    for r in sorted(rows, key=lambda r: r.batch):  # the last writer wins
        got[r.key, r.window_start_ms] = (r["sum"], r["count"])
    generator = GeneratorConfig(records=records, seed=seed, step=10)
    want = oracle.run([(x[0], x[1], x[2], x[3]) for x in (record(generator, o) for o in range(1, records + 1))], CONFIG).results
    missing = sum(k not in got for k in want)
    wrong = sum(k in got and got[k] != v for k, v in want.items()) + sum(k not in want for k in got)
    return Report(len(commits), len(offsets) > len(commits), tear, missing, wrong, len(rows) - len(got))


if __name__ == "__main__":
    child(sys.argv[1], int(sys.argv[2]), int(sys.argv[3]), int(sys.argv[4]), float(sys.argv[5]))
