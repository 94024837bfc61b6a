"""The same semantics over live streams.

Structured Streaming advances its watermark once for each micro-batch and its late filter lags one batch behind, so it
can't decide record by record. Two forms are offered:

* ``append_windows``: Spark's own watermark and append mode. Windows are emitted once, when the watermark passes their
  end; there is no final flush (an open window stays open until later records come).
* ``ExactLateness``: exact fires, re-fires, drops and collection with allowed lateness. Records carry the watermark in
  force (``wm_in``) and control rows (key null, ``wm`` set) raise it, as ``annotated`` makes them; a stateful processor,
  one for each partition number, holds panes and emits full aggregates. Its final watermark (END) flushes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.model import END, StreamConfig

EMISSION = "p int, wm long, kind string, key string, window_start_ms long, window_end_ms long, sum long, count long"
ANNOTATED = "p int, offset long, key string, value long, e long, wm long"


def append_windows(stream: DataFrame, config: StreamConfig) -> DataFrame:
    """Sum and count by key and window of a streaming frame (key, value, e), emitted when the watermark passes the end."""
    rows = stream.withColumn("time", F.timestamp_millis("e")).withWatermark("time", f"{config.disorder} milliseconds")
    ms = lambda n: f"{n} milliseconds"
    window = F.window("time", ms(config.size), ms(config.step)) if config.step <= config.size else None
    if window is None:
        raise ValueError("windows with gaps need the batch plan")
    out = rows.groupBy("key", window.alias("w")).agg(F.sum("value").alias("sum"), F.count("*").alias("count"))
    bounds = out.select("key", F.unix_millis("w.start").alias("window_start_ms"), F.unix_millis("w.end").alias("window_end_ms"), "sum", "count")
    return bounds.where("window_start_ms >= 0")  # windows before the epoch don't exist


def annotated(stream: DataFrame, wms: DataFrame, config: StreamConfig, partitions: int = 1, flush: bool = True) -> DataFrame:
    """A bounded stream as rows for ``ExactLateness``: records, and each watermark once for each partition after its interval.

    p is the partition, by FNV-1a of the key; offset orders the rows, a watermark coming after its interval's last record.
    """
    from tidemark.operators.partition import with_partition

    nothing = F.lit(None)
    records = with_partition(stream, partitions).select("p", (F.col("offset") * 2).alias("offset"), "key", "value", "e", nothing.cast("long").alias("wm"))
    every = F.explode(F.sequence(F.lit(0), F.lit(partitions - 1))).alias("p")
    marks = wms.select(every, (F.col("j") * config.interval * 2 + 1).alias("offset"), nothing.cast("string"), nothing.cast("long"), nothing.cast("long"), "wm")
    out = records.union(marks)
    if flush:
        last = stream.agg((F.max("offset") * 2 + 2).alias("offset")).select(every, "offset", nothing.cast("string"), nothing.cast("long"), nothing.cast("long"), F.lit(END).alias("wm"))
        out = out.union(last)
    return out


class ExactLateness(StatefulProcessor):
    """Windows of one partition: panes, and which windows have fired or wait to fire again.

    State is read and written where a batch touches it: ``live`` has a row for each live window (few, whatever the number
    of keys), ``keys`` numbers a window's keys as they come, and ``panes`` holds them by number, so a window that fires
    reads its own panes alone. Records between two watermarks are summed before state is touched.
    """

    def __init__(self, size: int, step: int, lateness: int) -> None:
        self.size, self.step, self.lateness = size, step, lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "s long", "fired boolean, again boolean, keys int")
        self.keys = handle.getMapState("keys", "s long, key string", "i int")
        self.panes = handle.getMapState("panes", "s long, i int", "key string, sum long, count long")
        self.now = handle.getValueState("now", "wm long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values("offset", kind="stable")
        wm = self.now.get()[0] if self.now.exists() else None
        live = {k[0]: list(v) for k, v in self.live.iterator()}
        before = set(live)
        out: list[tuple] = []
        control = batch["key"].isna().to_numpy()
        begin = 0
        for at in [*np.flatnonzero(control), len(batch)]:
            if at > begin:
                self._add(batch.iloc[begin:at], wm, live)
            if at < len(batch):
                new = int(batch["wm"].iloc[at])
                if wm is None or new > wm:
                    wm = new
                    self._advance(int(key[0]), wm, live, out)
            begin = at + 1
        for s in before - set(live):
            self.live.removeKey((s,))
        for s, mark in live.items():
            self.live.updateValue((s,), tuple(mark))
        if wm is not None:
            self.now.update((wm,))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in EMISSION.split(", ")])

    def _add(self, records: pd.DataFrame, wm: int | None, live: dict) -> None:
        """Sum the records under one watermark by window and key, and add the sums to the panes of windows that are not over."""
        e = records["e"].to_numpy(np.int64)
        last = e // self.step * self.step
        sums = []
        for back in range(-(-self.size // self.step)):
            s = last - back * self.step
            inside = (s >= 0) & (s + self.size > e)
            if wm is not None:
                inside &= s + self.size + self.lateness > wm
            own = pd.DataFrame({"s": s[inside], "key": records["key"].to_numpy()[inside], "value": records["value"].to_numpy(np.int64)[inside]})
            sums.append(own)
        added = pd.concat(sums).groupby(["s", "key"])["value"].agg(["sum", "count"])
        for (s, key), total, count in zip(added.index, added["sum"].tolist(), added["count"].tolist(), strict=True):
            s = int(s)
            mark = live.setdefault(s, [False, False, 0])
            mark[1] = mark[0]
            if self.keys.containsKey((s, key)):
                i = self.keys.getValue((s, key))[0]
                _, a, b = self.panes.getValue((s, i))
                total, count = total + a, count + b
            else:
                i = mark[2]
                mark[2] += 1
                self.keys.updateValue((s, key), (i,))
            self.panes.updateValue((s, i), (key, total, count))

    def _advance(self, p: int, wm: int, live: dict, out: list) -> None:
        """First fires in order of window ends, then re-fires, then collection."""
        first = [s for s in sorted(live) if not live[s][0] and s + self.size <= wm]
        again = [s for s in sorted(live) if live[s][1]]
        for kind, windows in (("fire", first), ("refire", again)):
            for s in windows:
                live[s][:2] = [True, False]
                panes = sorted(self.panes.getValue((s, i)) for i in range(live[s][2]))
                out += [(p, wm, kind, k, s, s + self.size, total, count) for k, total, count in panes]
        for s in [s for s in live if live[s][0] and wm >= s + self.size + self.lateness]:
            for i in range(live.pop(s)[2]):
                self.keys.removeKey((s, self.panes.getValue((s, i))[0]))
                self.panes.removeKey((s, i))

    def close(self) -> None:
        pass


def state_rows(spark: SparkSession, checkpoint: str, name: str = "panes") -> DataFrame:
    """The real state of a stopped or running ``exact_windows`` query, by Spark's state reader: live, keys, panes or now."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def exact_windows(rows: DataFrame, config: StreamConfig) -> DataFrame:
    """The changelog of a streaming frame of ``annotated`` rows. Needs the RocksDB state store."""
    processor = ExactLateness(config.size, config.step, config.lateness)
    return rows.groupBy("p").transformWithStateInPandas(processor, outputStructType=EMISSION, outputMode="Append", timeMode="None")
