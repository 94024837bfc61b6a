"""Merging K sources: the round-robin order, the combined watermark with idle sources, and aligned cuts.

A source's items are its records, a watermark after each ``interval`` of them, and empty ticks where it is idle. Item m of
source i is taken in turn (m, i), so an item's place among all follows from counts alone: no sort of the records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import carry_forward
from tidemark.model import StreamConfig


@dataclass(frozen=True)
class IdleSpan:
    """Source ``src`` gives nothing for ``length`` turns right after its record ``start``; it is idle from turn ``timeout`` on."""

    src: int
    start: int
    length: int
    timeout: int = 30


def _of(idle: tuple[IdleSpan, ...], src: int) -> list[IdleSpan]:
    """The spans of a source by their starts, which differ."""
    return sorted((x for x in idle if x.src == src), key=lambda x: x.start)


def _plain_end(record: int, interval: int) -> int:
    """Items up to a record, that one included and its watermark not, ticks left out."""
    return record + (record - 1) // interval if record else 0


def place(record: Column, src: int, interval: int, idle: tuple[IdleSpan, ...] = ()) -> Column:
    """The item number of a record of source ``src``."""
    m = record + F.floor((record - 1) / interval)
    return sum((F.when(record > x.start, x.length).otherwise(0) for x in _of(idle, src)), m)


def consumed(upto: Column, src: int, interval: int, idle: tuple[IdleSpan, ...], total: int) -> Column:
    """Records among the first ``upto`` items of a source that has ``total`` records."""
    plain = lambda x: x - F.floor(x / (interval + 1))
    spans = [x for x in _of(idle, src) if x.start <= total]
    n = plain(upto - sum(x.length for x in spans))
    for x in reversed(spans):
        ticks = sum(y.length for y in spans if y.start < x.start)
        first = _plain_end(x.start, interval) + ticks
        n = F.when(upto <= first, plain(upto - ticks)).when(upto <= first + x.length, F.lit(x.start)).otherwise(n)
    return F.least(F.greatest(n, F.lit(0)), F.lit(total))


def source_counts(sources: DataFrame, k: int) -> list[int]:
    """Records of each of k sources."""
    counts = {r.src: r["count"] for r in sources.groupBy("src").count().collect()}  # k rows
    return [counts.get(i, 0) for i in range(k)]


def _by_source(k: int, value) -> Column:
    return F.element_at(F.array(*(value(i) for i in range(k))), F.col("src") + 1)


def _merged(m: Column, k: int, interval: int, idle: tuple[IdleSpan, ...], totals: list[int], src: Column) -> Column:
    """Records of all sources up to item m of source ``src``, that one included."""
    return sum((consumed(F.when(F.lit(i) <= src, m).otherwise(m - 1), i, interval, idle, totals[i]) for i in range(k)), F.lit(0))


def merge_sources(sources: DataFrame, k: int, config: StreamConfig, idle: tuple[IdleSpan, ...] = ()) -> DataFrame:
    """``sources`` (src, src_offset, ...) with merged_offset, the place of each record in the merged stream."""
    totals = source_counts(sources, k)
    rows = sources.withColumn("m", _by_source(k, lambda i: place(F.col("src_offset"), i, config.interval, idle)))
    return rows.withColumn("merged_offset", _merged(F.col("m"), k, config.interval, idle, totals, F.col("src")).cast("long")).drop("m")


def combined_watermark(sources: DataFrame, k: int, config: StreamConfig, idle: tuple[IdleSpan, ...] = ()) -> DataFrame:
    """merged_offset, wm_ms: the emitted watermarks of the merged stream.

    Each source's own watermark rises with its records; the merged one is the least over sources that are not idle (a
    source that has not reported holds it back, an ended one stays as it is) and is emitted when it strictly rises. A
    source that resumes counts again before its item is read, and that alone emits nothing.
    """
    i = config.interval
    totals = source_counts(sources, k)
    tops = sources.groupBy("src", F.floor((F.col("src_offset") - 1) / i + 1).alias("j")).agg(F.max("e").alias("top"), F.count("*").alias("n")).where(F.col("n") == i)
    m = F.col("j") * i + F.col("j")
    shift = _by_source(k, lambda s: sum((F.when(F.col("j") * i >= x.start, x.length).otherwise(0) for x in _of(idle, s)), F.lit(0)))
    events = tops.select((m + shift).alias("m"), "src", F.lit(1).alias("sub"), *(F.when(F.col("src") == s, F.greatest(F.lit(0), F.col("top") - config.disorder)).alias(f"w{s}") for s in range(k)), *(F.lit(None).cast("boolean").alias(f"i{s}") for s in range(k)), F.lit(True).alias("may_emit"))
    spark = sources.sparkSession
    marks = []
    for x in idle:
        first = _plain_end(x.start, i) + sum(y.length for y in _of(idle, x.src) if y.start < x.start)
        if x.length >= x.timeout and x.start <= totals[x.src]:
            marks.append((first + x.timeout, x.src, 1, True, True))
            if x.start < totals[x.src] or x.start % i == 0:
                marks.append((first + x.length + 1, x.src, 0, False, False))
    if marks:
        extra = spark.createDataFrame(marks, "m long, src int, sub int, idle boolean, may_emit boolean")
        events = events.unionByName(extra.select("m", "src", "sub", *(F.lit(None).cast("long").alias(f"w{s}") for s in range(k)), *(F.when(F.col("src") == s, F.col("idle")).alias(f"i{s}") for s in range(k)), "may_emit"))
    events = events.withColumn("bucket", F.floor(F.col("m") / 65_536))
    order = ["m", "src", "sub"]
    # A source's watermark never falls.
    events = carry_forward(events, "bucket", order, {f"W{s}": f"w{s}" for s in range(k)}, "max")
    events = carry_forward(events, "bucket", order, {f"I{s}": f"i{s}" for s in range(k)}, "last")
    active = [~F.coalesce(F.col(f"I{s}"), F.lit(False)) for s in range(k)]
    blocked = F.lit(False)
    for s in range(k):
        blocked = blocked | (active[s] & F.col(f"W{s}").isNull())
    values = [F.when(active[s], F.col(f"W{s}")) for s in range(k)]
    least = values[0] if k == 1 else F.least(*values)
    events = events.withColumn("least", F.when(~blocked, least))
    events = carry_forward(events, "bucket", order, {"upto": "least"}, "max")
    # A rise at an event is a rise over all events before it.
    events = events.withColumn("seq", F.struct("m", "src", "sub"))
    firsts = events.where("upto is not null").groupBy("upto").agg(F.min(F.struct("seq", "may_emit")).alias("x"))
    rises = firsts.where("x.may_emit").select(F.col("x.seq.m").alias("m"), F.col("x.seq.src").alias("src"), F.col("upto").alias("wm_ms"))
    return rises.select(_merged(F.col("m"), k, i, idle, totals, F.col("src")).cast("long").alias("merged_offset"), F.col("wm_ms").cast("long"))


def with_watermark(stream: DataFrame, wms: DataFrame) -> DataFrame:
    """``stream`` (offset) with wm_in, the last watermark (merged_offset, wm_ms) emitted before each record."""
    names = stream.columns
    both = stream.withColumn("after", F.lit(0)).withColumn("wm", F.lit(None).cast("long"))
    marks = wms.select(*(F.col("merged_offset").alias(c) if c == "offset" else F.lit(None).cast(stream.schema[c].dataType).alias(c) for c in names), F.lit(1).alias("after"), F.col("wm_ms").alias("wm"))
    both = both.unionByName(marks).withColumn("bucket", F.floor(F.col("offset") / 65_536))
    rows = carry_forward(both, "bucket", ["offset", "after", "wm"], {"wm_in": "wm"}, "max")
    return rows.where("after = 0").select(*names, "wm_in")


def source_intervals(own: list[int], default: int) -> list[int]:
    """Each source's records between barriers: its own number, or that of the merge where it has none (0)."""
    return [x or default for x in own]


def cuts_with_gaps(sources: DataFrame, intervals: list[int], interval: int, idle: tuple[IdleSpan, ...] = ()) -> DataFrame:
    """epoch, cut_offset: the aligned cuts with watermark turns, idle and ended sources, from the sources' counts."""
    cuts = align(source_counts(sources, len(intervals)), intervals, interval, idle)
    return sources.sparkSession.createDataFrame(list(enumerate(cuts, 1)), "epoch long, cut_offset long")


def aligned_cuts(sources: DataFrame, intervals: list[int]) -> DataFrame:
    """epoch, cut_offset: the merged cuts while all sources are live; epoch n holds n intervals of each source."""
    k = len(intervals)
    totals = source_counts(sources, k)
    epochs = min((n // i for n, i in zip(totals, intervals, strict=True)), default=0)
    return sources.sparkSession.range(1, epochs + 1).select(F.col("id").alias("epoch"), (F.col("id") * sum(intervals)).alias("cut_offset"))


@dataclass
class _Channel:
    """One source as the merge sees it, by counts: what it gives at its next turn, and how many turns are plain from there."""

    total: int
    interval: int
    barrier: int
    spans: list[tuple[int, int]]
    timeout: int
    plain: int = 0  # records and watermarks taken
    ticks: int = 0  # left of the gap it is in
    empty: int = 0
    idle: bool = False
    ended: bool = False
    delivered: int = 0
    barrier_due: bool = False

    @property
    def records(self) -> int:
        return self.plain - self.plain // (self.interval + 1) if self.interval else self.plain

    def _watermark_due(self) -> bool:
        return bool(self.interval) and self.plain % (self.interval + 1) == self.interval

    def room(self) -> int:
        """Turns from here on that give records or watermarks and nothing else."""
        if self.ticks or self.empty or self.idle or self.barrier_due or self._watermark_due():
            return 0
        r = self.records
        marks = [self.total, *(start for start, _ in self.spans)]
        if self.barrier:
            marks.append((r // self.barrier + 1) * self.barrier)
        last = min(marks)  # this record is taken by itself, as something follows it
        upto = last - 1
        return max(0, upto + (upto // self.interval if self.interval else 0) - self.plain)

    def skip(self, turns: int) -> int:
        before = self.records
        self.plain += turns
        return self.records - before

    def take(self) -> str:
        """One turn: record, watermark, barrier, tick, idle (the tick at which it becomes so) or end."""
        if not self.ticks and self.spans and self.spans[0][0] == self.records:
            self.ticks = self.spans.pop(0)[1]
        if self.ticks:
            self.ticks -= 1
            self.empty += 1
            if self.timeout and not self.idle and self.empty >= self.timeout:
                self.idle = True
                return "idle"
            return "tick"
        if not (self.barrier_due or self._watermark_due()) and self.records >= self.total:
            self.ended = True
            return "end"
        self.idle, self.empty = False, 0
        if self._watermark_due():
            self.plain += 1
            return "watermark"
        if self.barrier_due:
            self.barrier_due = False
            self.delivered += 1
            return "barrier"
        self.plain += 1
        self.barrier_due = bool(self.barrier) and self.records % self.barrier == 0
        return "record"


def align(totals: list[int], barriers: list[int], interval: int = 0, idle: tuple[IdleSpan, ...] = ()) -> list[int]:
    """Merged offsets of all aligned cuts, idle and ended sources included, from counts alone (control data, on the driver).

    barriers: each source's records between barriers. interval: records between watermarks, which take a turn too. A
    source that has delivered a barrier waits until every source that is neither idle nor ended has; then one cut is
    made. Turns between barriers and gaps are counted, not walked, so the work grows with the cuts, not with the records.
    """
    k = len(totals)
    channels = [_Channel(totals[i], interval, barriers[i], [(x.start, x.length) for x in _of(idle, i)], next((x.timeout for x in _of(idle, i)), 0)) for i in range(k)]
    cuts: list[int] = []
    merged = turn = 0
    while True:
        free = [i for i, c in enumerate(channels) if not c.ended and c.delivered <= len(cuts)]
        if not free:
            return cuts
        rounds = min(channels[i].room() for i in free)
        if rounds:
            merged += sum(channels[i].skip(rounds) for i in free)
        i = min(free, key=lambda x: (x - turn) % k)
        event = channels[i].take()
        merged += event == "record"
        if event in ("barrier", "idle", "end"):
            live = [c for c in channels if not c.idle and not c.ended]
            if live and all(c.delivered > len(cuts) for c in live):
                cuts.append(merged)
        turn = i + 1


def seek_merged(merged: DataFrame, offset: int) -> DataFrame:
    """The records after a merged offset; offsets stay absolute. The merge is a function of its sources, so nothing is replayed."""
    return merged.where(F.col("merged_offset") > offset)
