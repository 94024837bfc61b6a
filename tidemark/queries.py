"""The catalogue of window-engine queries: (spark, folder of tables) -> DataFrame, and their DuckDB twins.

The stream is ``events`` with delays (sources/tables.py). The SQL takes other routes than the plans where it can: range
joins for windows, correlated minima for slots.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoints import CheckpointStore, Snapshot, checkpoint_files, partition_stores
from tidemark.model import HOUR, StreamConfig
from tidemark.operators import checkpoint, emissions, lateness, merge, partition, watermark, windows
from tidemark.plans.scratch import scratch_folder, written
from tidemark.sources import tables
from tidemark.sources.generator import MULTIPLIERS, PRIME, GeneratorConfig, generate

TUMBLING = StreamConfig(6 * HOUR)
TUMBLING_LATE = StreamConfig(6 * HOUR, lateness=12 * HOUR)
SLIDING = StreamConfig(6 * HOUR, slide=2 * HOUR)
SLIDING_LATE = StreamConfig(6 * HOUR, slide=2 * HOUR, lateness=12 * HOUR)
GAPS = StreamConfig(5 * HOUR, slide=8 * HOUR)
IDLE = (merge.IdleSpan(src=2, start=60, length=150, timeout=30),)
BARRIER, SNAPSHOT, CRASH, STOP = 100, 500, 800, 700
SOURCES = 3
PARTS = 2
BOUNDED, HEAVY = GeneratorConfig(), GeneratorConfig(records=20_000, keys=10, late_fraction=0.1)


class Run:
    """The frames of one configuration over the stream, made as they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: StreamConfig, stream: DataFrame | None = None, parts: int = 0) -> None:
        self.config = config
        self.group = ["p", "s"] if parts else ["s"]
        self.stream = tables.event_stream(spark, sf_dir) if stream is None else stream
        if parts:
            self.stream = partition.with_partition(self.stream, parts)

    @cached_property
    def wms(self) -> DataFrame:
        return written(watermark.trajectory(self.stream, self.config), "watermarks")

    @cached_property
    def adv(self) -> DataFrame:
        return watermark.advances(self.wms)

    @cached_property
    def all_pairs(self) -> DataFrame:
        """Written, since fires, late records and results all read it."""
        return written(lateness.classify(self.stream, self.wms, self.config), "pairs")

    @cached_property
    def pairs(self) -> DataFrame:
        return self.all_pairs.where(~F.col("dropped"))

    @cached_property
    def fires(self) -> DataFrame:
        return written(emissions.first_fires(self.pairs, self.adv, self.config, self.group), "fires")

    @cached_property
    def late(self) -> DataFrame:
        return written(emissions.late_accepted(self.pairs, self.fires, self.adv, self.group), "late")

    def results(self) -> DataFrame:
        return windows.sum_count(self.pairs, self.config)

    def log(self) -> DataFrame:
        return emissions.changelog(self.pairs, emissions.emission_slots(self.fires, self.late), self.config)


def watermark_trajectory(spark: SparkSession, d: str) -> DataFrame:
    return watermark.trajectory(tables.event_stream(spark, d), TUMBLING).select("j", F.col("wm").alias("wm_ms"))


def watermark_advances(spark: SparkSession, d: str) -> DataFrame:
    return watermark.advances(watermark.trajectory(tables.event_stream(spark, d), TUMBLING)).select("j", F.col("wm").alias("wm_ms"))


def _plain(config: StreamConfig) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: windows.sum_count(windows.assign_windows(tables.event_stream(spark, d), config), config)


def _accepted(config: StreamConfig) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: windows.sum_count(lateness.accepted(tables.event_stream(spark, d), config), config)


def late_accepted(spark: SparkSession, d: str) -> DataFrame:
    late = Run(spark, d, SLIDING_LATE).late
    return late.select("offset", F.col("s").alias("window_start_ms"), emissions.shown("refire").alias("refire_slot"))


def window_fires(spark: SparkSession, d: str) -> DataFrame:
    return Run(spark, d, SLIDING_LATE).fires.select(F.col("s").alias("window_start_ms"), emissions.shown("fire").alias("slot"))


def window_refires(spark: SparkSession, d: str) -> DataFrame:
    return Run(spark, d, SLIDING_LATE).late.select(F.col("s").alias("window_start_ms"), emissions.shown("refire").alias("slot")).distinct()


def final_flush(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d, SLIDING_LATE)
    slots = emissions.emission_slots(run.fires, run.late).withColumn("at", emissions.shown("at"))
    return slots.where("at = -1").select(F.col("s").alias("window_start_ms"), "kind")


def emission_changelog(spark: SparkSession, d: str) -> DataFrame:
    log = Run(spark, d, SLIDING_LATE).log()
    return log.select(emissions.shown("at").alias("slot"), "kind", "key", F.col("s").alias("window_start_ms"), "sum", "count")


def authoritative_results(spark: SparkSession, d: str) -> DataFrame:
    return emissions.authoritative(Run(spark, d, SLIDING_LATE).log(), SLIDING_LATE)


def _stats(run: Run) -> DataFrame:
    """One row: the counters of a run."""
    rows = run.all_pairs.agg(F.countDistinct("offset").alias("records_processed"))  # tumbling or overlapping windows: every record has one
    fired = run.fires.agg(F.count("*").alias("windows_fired"))
    refired = run.late.select(*run.group, "refire").distinct().agg(F.count("*").alias("windows_refired"))
    late = run.late.agg(F.countDistinct("offset").alias("late_records_accepted"))
    lost = run.all_pairs.where("dropped").agg(F.countDistinct("offset").alias("late_records_dropped"))
    adv = run.adv.agg(F.count("*").alias("watermarks_advanced"))
    for other in (fired, refired, late, lost, adv):  # one row each
        rows = rows.join(F.broadcast(other), how="inner")
    return rows


def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(Run(spark, d, SLIDING_LATE)).withColumn("checkpoints_written", F.floor(F.col("records_processed") / BARRIER))


def partitioned_stats(spark: SparkSession, d: str) -> DataFrame:
    out = [_stats(Run(spark, d, TUMBLING_LATE, parts=n)).select(F.lit(n).alias("n"), "windows_fired", "windows_refired", "late_records_accepted", "late_records_dropped") for n in (1, 2, 4)]
    return out[0].union(out[1]).union(out[2])


def drop_contract(spark: SparkSession, d: str) -> DataFrame:
    """Dropped records by the engine, and predicted record by record from the running maximum of whole intervals."""
    run = Run(spark, d, TUMBLING_LATE)
    engine = run.all_pairs.where("dropped").agg(F.countDistinct("offset").alias("engine_dropped"))
    c = run.config
    # A record is lost if an earlier whole interval holds an event time late enough for its window's end.
    need = F.floor(F.col("e") / c.size) * c.size + c.size + c.lateness + c.disorder
    rows = run.stream.select("offset", need.alias("need"), F.floor((F.col("offset") - 1) / c.interval).alias("slot"))
    tops = run.wms.select(F.col("j").alias("slot"), (F.col("wm") + c.disorder).alias("top"))
    lost = rows.join(tops, "slot").where("top >= need").agg(F.count("*").alias("predicted_dropped"))
    return engine.join(F.broadcast(lost), how="inner")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return written(tables.split_sources(written(tables.event_stream(spark, d), "stream"), SOURCES), "sources")


def _merged(idle: tuple[merge.IdleSpan, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = merge.merge_sources(_sources(spark, d), SOURCES, TUMBLING, idle)
        return out.select("merged_offset", "src", "key", "value", F.col("e").alias("event_time_ms"))

    return query


def _combined(idle: tuple[merge.IdleSpan, ...]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: merge.combined_watermark(_sources(spark, d), SOURCES, TUMBLING, idle)


def merged_late_drop(spark: SparkSession, d: str) -> DataFrame:
    """Results over the merged stream: the watermark in force is the last one emitted before the record."""
    sources = _sources(spark, d)
    stream = merge.merge_sources(sources, SOURCES, TUMBLING_LATE).withColumn("offset", F.col("merged_offset"))
    wms = merge.combined_watermark(sources, SOURCES, TUMBLING_LATE)
    rows = merge.with_watermark(stream, wms)
    pairs = lateness.mark_dropped(windows.assign_windows(rows, TUMBLING_LATE), TUMBLING_LATE)
    return windows.sum_count(pairs.where(~F.col("dropped")), TUMBLING_LATE)


def barrier_offsets(spark: SparkSession, d: str) -> DataFrame:
    return checkpoint.barriers(tables.event_stream(spark, d), BARRIER)


def aligned_cuts(spark: SparkSession, d: str) -> DataFrame:
    return merge.aligned_cuts(_sources(spark, d), [10, 20, 30])


def partition_assign(spark: SparkSession, d: str) -> DataFrame:
    keys = tables.event_stream(spark, d).select("key").distinct()
    out = [keys.select("key", F.lit(n).alias("n"), partition.partition_of(F.col("key"), n).alias("partition")) for n in (1, 2, 4, 8)]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def pane_snapshot_at(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d, TUMBLING_LATE)
    panes = checkpoint.panes_at(run.pairs, run.fires, run.wms, SNAPSHOT, run.config)
    return panes.select("key", F.col("s").alias("window_start_ms"), (F.col("s") + run.config.size).alias("window_end_ms"), "sum", "count", "fired")


def restore_equivalence(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d, TUMBLING_LATE)
    panes = checkpoint.panes_at(run.pairs, run.fires, run.wms, SNAPSHOT, run.config)
    return checkpoint.restore(run.pairs, panes, run.log(), SNAPSHOT, run.config)


def recovery_union(spark: SparkSession, d: str) -> DataFrame:
    run = Run(spark, d, TUMBLING_LATE)
    return checkpoint.recovery_union(run.log(), SNAPSHOT // run.config.interval, CRASH // run.config.interval, run.config)


def _snapshot(stores: list[CheckpointStore], run: Run, offset: int) -> None:
    """Write the state after ``offset`` records: to each store the panes of its partition, and all windows. The sums are taken once."""
    panes = written(checkpoint.panes_at(run.pairs, run.fires, run.wms, offset, run.config), "panes")
    marks = written(checkpoint.window_marks(panes, run.late, offset, run.config), "marks")
    wm = run.wms.where(F.col("j") == offset // run.config.interval).first()
    for part, store in enumerate(stores):
        own = partition.with_partition(panes, len(stores)).where(F.col("p") == part) if len(stores) > 1 else panes
        store.write(offset, wm.wm if wm else None, own, marks)


def _shown(snapshot: Snapshot, run: Run) -> DataFrame:
    out = snapshot.panes.join(F.broadcast(snapshot.windows), "s")  # live windows: a row for each
    return out.select("key", F.col("s").alias("window_start_ms"), (F.col("s") + run.config.size).alias("window_end_ms"), "sum", "count", "fired")


def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot as loaded from its files."""
    run, store = Run(spark, d, TUMBLING_LATE), CheckpointStore(spark, scratch_folder(spark, "checkpoints"))
    _snapshot([store], run, SNAPSHOT)
    return _shown(store.load(SNAPSHOT), run)


def torn_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The newest of two snapshots is torn: the one before it is loaded."""
    run, store = Run(spark, d, TUMBLING_LATE), CheckpointStore(spark, scratch_folder(spark, "checkpoints"))
    for offset in (SNAPSHOT - BARRIER, SNAPSHOT):
        _snapshot([store], run, offset)
    store.folder.delete(f"checkpoint-{SNAPSHOT}/windows")
    return _shown(store.load_latest(), run)


def restore_from_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Results of a run restored from stored files and replayed after them."""
    run, store = Run(spark, d, TUMBLING_LATE), CheckpointStore(spark, scratch_folder(spark, "checkpoints"))
    _snapshot([store], run, SNAPSHOT)
    snapshot = store.load_latest()
    return checkpoint.restore(run.pairs, snapshot.panes, run.log(), snapshot.offset, run.config)


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots that partitions have of the last two barriers; the last set is torn, one partition's manifest is gone."""
    run = Run(spark, d, TUMBLING_LATE, written(tables.event_stream(spark, d), "stream"))
    last = checkpoint.barriers(run.stream, BARRIER).agg(F.max("cut_offset").alias("last")).first().last or 0
    stores = partition_stores(spark, scratch_folder(spark, "checkpoints"), PARTS)
    for offset in (last - BARRIER, last):
        if offset > 0:  # a short stream has one barrier or none
            _snapshot(stores, run, offset)
    stores[0].folder.delete(f"checkpoint-{last}/manifest")
    return checkpoint_files(spark, stores)


def highest_complete_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return checkpoint.highest_complete(_files(spark, d), PARTS)


def highest_partial_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return checkpoint.highest_partial(_files(spark, d))


def cuts_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Aligned cuts of sources of which one is idle for a while."""
    return merge.cuts_with_gaps(_sources(spark, d), merge.source_intervals([BARRIER // 10, 0, 0], BARRIER // 5), TUMBLING.interval, IDLE)


def merged_seek(spark: SparkSession, d: str) -> DataFrame:
    """The merged stream after an offset, idle spans before it included."""
    out = merge.seek_merged(merge.merge_sources(_sources(spark, d), SOURCES, TUMBLING, IDLE), SNAPSHOT)
    return out.select("merged_offset", "src", "key", "value", F.col("e").alias("event_time_ms"))


def merge_one(spark: SparkSession, d: str) -> DataFrame:
    """One source merged: the order and the strict advances of its own watermark."""
    one = written(tables.split_sources(written(tables.event_stream(spark, d), "stream"), 1), "sources")
    stream = merge.merge_sources(one, 1, TUMBLING).withColumn("offset", F.col("merged_offset"))
    rows = merge.with_watermark(stream, merge.combined_watermark(one, 1, TUMBLING))
    return rows.select("merged_offset", "key", "value", F.col("e").alias("event_time_ms"), F.col("wm_in").alias("wm_ms"))


def output_watermark(spark: SparkSession, d: str) -> DataFrame:
    """The least watermark over the partitions after each barrier: all of them see every watermark."""
    wms = Run(spark, d, TUMBLING).wms
    marks = wms.where(F.col("j") * TUMBLING.interval % BARRIER == 0)
    seen = marks.withColumn("p", F.explode(F.array(*map(F.lit, range(PARTS)))))
    return seen.groupBy("j").agg(F.min("wm").alias("wm_ms")).select((F.col("j") * TUMBLING.interval).alias("cut_offset"), "wm_ms")


def stop_at(spark: SparkSession, d: str) -> DataFrame:
    return Run(spark, d, TUMBLING_LATE, tables.stop_at(tables.event_stream(spark, d), STOP)).results()


def seek_resume(spark: SparkSession, d: str) -> DataFrame:
    """Results of the records after an offset, under the trajectory of the whole prefix."""
    return windows.sum_count(tables.seek(Run(spark, d, TUMBLING_LATE).pairs, SNAPSHOT), TUMBLING_LATE)


def gen_bounded(spark: SparkSession, d: str) -> DataFrame:
    return generate(spark, BOUNDED)


def gen_heavy_tailed(spark: SparkSession, d: str) -> DataFrame:
    return generate(spark, HEAVY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "watermark_trajectory": watermark_trajectory,
    "watermark_advances": watermark_advances,
    "tumbling_sum_count": _plain(TUMBLING),
    "sliding_sum_count": _plain(SLIDING),
    "hopping_gap": _plain(GAPS),
    "late_drop_l0": _accepted(TUMBLING),
    "late_drop_lpos": _accepted(SLIDING_LATE),
    "late_accepted": late_accepted,
    "window_fires": window_fires,
    "window_refires": window_refires,
    "final_flush": final_flush,
    "emission_changelog": emission_changelog,
    "authoritative_results": authoritative_results,
    "run_stats": run_stats,
    "drop_contract": drop_contract,
    "min_watermark": _combined(()),
    "min_watermark_idle": _combined(IDLE),
    "merge_sources": _merged(()),
    "merge_idle": _merged(IDLE),
    "merged_late_drop": merged_late_drop,
    "barrier_offsets": barrier_offsets,
    "aligned_cuts": aligned_cuts,
    "partition_assign": partition_assign,
    "partitioned_stats": partitioned_stats,
    "pane_snapshot_at": pane_snapshot_at,
    "restore_equivalence": restore_equivalence,
    "recovery_union": recovery_union,
    "highest_complete_checkpoint": highest_complete_checkpoint,
    "highest_partial_checkpoint": highest_partial_checkpoint,
    "snapshot_roundtrip": snapshot_roundtrip,
    "torn_fallback": torn_fallback,
    "restore_from_snapshot": restore_from_snapshot,
    "cuts_with_gaps": cuts_with_gaps,
    "merged_seek": merged_seek,
    "merge_one": merge_one,
    "output_watermark": output_watermark,
    "stop_at": stop_at,
    "seek_resume": seek_resume,
    "gen_bounded": gen_bounded,
    "gen_heavy_tailed": gen_heavy_tailed,
}

_STREAM = f"""st AS (SELECT event_id, k, v, e, row_number() OVER (ORDER BY e + delay, event_id) AS o FROM (
  SELECT event_id, 'key-' || lpad((user_id % 10)::VARCHAR, 4, '0') AS k, round(value * 100)::BIGINT AS v, epoch_us(ts) // 1000 AS e,
    CASE WHEN event_id % 10 = 3 THEN (event_id * 7919 % 1009) * 180000 ELSE (event_id * 104729 % 1013) * 3500 END AS delay FROM events))"""


def _sql(config: StreamConfig, body: str, stop: int = 0, keyed: str = "") -> str:
    """Common tables: st, wm (j, wm), adv, pairs, acc, fires (s, fj), late (with rj). ``body`` reads them."""
    c = config
    source = f"cut AS (SELECT * FROM st WHERE o <= {stop})" if stop else "cut AS (SELECT * FROM st)"
    p = keyed or "0"
    return f"""WITH {_STREAM}, {source},
wm AS (SELECT j, greatest(0, max(m) OVER (ORDER BY j) - {c.disorder}) AS wm FROM (SELECT (o - 1) // {c.interval} + 1 AS j, max(e) AS m, count(*) AS n FROM cut GROUP BY 1) WHERE n = {c.interval}),
adv AS (SELECT j, wm FROM (SELECT *, lag(wm) OVER (ORDER BY j) AS b FROM wm) WHERE b IS NULL OR wm > b),
starts AS (SELECT unnest(range(greatest(0, min(e) // {c.step} * {c.step} - {(c.size // c.step + 1) * c.step}), max(e) + 1, {c.step})) AS s FROM cut),
pairs AS (SELECT o, k, v, e, s, (o - 1) // {c.interval} AS slot, {p} AS p FROM cut JOIN starts ON e >= s AND e < s + {c.size}),
judged AS (SELECT pairs.*, coalesce(wm >= s + {c.size + c.lateness}, false) AS dropped FROM pairs LEFT JOIN wm ON wm.j = slot),
acc AS (SELECT * FROM judged WHERE NOT dropped),
fires AS (SELECT p, s, coalesce(min(j), -1) AS fj FROM (SELECT p, s, min(o) AS o0 FROM acc GROUP BY 1, 2) LEFT JOIN adv ON j * {c.interval} >= o0 AND wm >= s + {c.size} GROUP BY 1, 2),
lates AS (SELECT acc.*, fj FROM acc JOIN fires USING (p, s) WHERE fj >= 0 AND fj <= slot),
nexts AS (SELECT slot, coalesce(min(j), -1) AS rj FROM (SELECT DISTINCT slot FROM lates) LEFT JOIN adv ON j > slot GROUP BY 1),
late AS (SELECT lates.*, rj FROM lates JOIN nexts USING (slot)),
em AS (SELECT s, fj AS sl, 'fire' AS kind FROM fires UNION ALL SELECT DISTINCT s, rj, 'refire' FROM late),
log AS (SELECT sl, kind, k, s, sum(v)::BIGINT AS total, count(*) AS n FROM em JOIN acc USING (s) WHERE sl = -1 OR o <= sl * {c.interval} GROUP BY 1, 2, 3, 4)
{body}"""


def _result(rows: str, size: int) -> str:
    return f'SELECT k AS "key", s AS window_start_ms, s + {size} AS window_end_ms, sum(v)::BIGINT AS "sum", count(*) AS "count" FROM {rows} GROUP BY k, s'


_FNV = "list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(string_split(k, ''), lambda x: ascii(x)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_COUNTERS = "(SELECT count(*) FROM fires) AS windows_fired, (SELECT count(*) FROM (SELECT DISTINCT p, s, rj FROM late)) AS windows_refired, (SELECT count(DISTINCT o) FROM late) AS late_records_accepted, (SELECT count(DISTINCT o) FROM judged WHERE dropped) AS late_records_dropped"


def _merge_sql(body: str, idle: bool) -> str:
    """Items of all sources by explicit numbering: records, watermarks and ticks are listed, ordered and counted."""
    i, d, x = TUMBLING.interval, TUMBLING.disorder, IDLE[0]
    ticks = f"UNION ALL SELECT {x.src}, {x.start} + 0.25 + t / 1000.0 * 0.1, 't', NULL, NULL, NULL, t FROM range(1, {x.length + 1}) r(t)" if idle else ""
    mark = f"src = {x.src} AND kind = 't' AND t >= {x.timeout}" if idle else "false"
    return f"""WITH {_STREAM},
src AS (SELECT (event_id % {SOURCES})::INT AS src, k, v, (SELECT min(e) FROM st) + (e - (SELECT min(e) FROM st)) * ({SOURCES} - event_id % {SOURCES}) AS e, row_number() OVER (PARTITION BY event_id % {SOURCES} ORDER BY o) AS so FROM st),
raw AS (SELECT src, so::DOUBLE AS sl, 'r' AS kind, k, v, e, NULL::BIGINT AS t FROM src
  UNION ALL SELECT src, so + 0.5, 'w', NULL, NULL, greatest(0, m - {d}), NULL FROM (SELECT src, so, max(e) OVER (PARTITION BY src ORDER BY so) AS m FROM src) WHERE so % {i} = 0
  {ticks}),
items AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sl) AS m FROM raw),
seq AS (SELECT *, row_number() OVER (ORDER BY m, src) AS g, sum((kind = 'r')::INT) OVER (ORDER BY m, src)::BIGINT AS merged_offset FROM items)
{body.replace('%MARK%', mark)}"""


_STATES = ", ".join(f"max(CASE WHEN kind = 'w' AND src = {s} THEN e END) OVER (ORDER BY g) AS w{s}, coalesce(last_value(CASE WHEN src = {s} THEN (%MARK%) END IGNORE NULLS) OVER (ORDER BY g), false) AS i{s}" for s in range(SOURCES))
_BEFORE = ", ".join(f"lag(w{s}) OVER (ORDER BY g) AS b{s}, coalesce(lag(i{s}) OVER (ORDER BY g), false) AS d{s}" for s in range(SOURCES))


def _least(w: str, i: str, own: str = "") -> str:
    """The combined watermark of the states; null while an active source has not reported or all are idle."""
    blocked = " OR ".join(f"(NOT {i}{s} AND {w}{s} IS NULL)" for s in range(SOURCES))
    return f"CASE WHEN NOT ({blocked}) THEN list_min(list_filter([{', '.join(f'CASE WHEN NOT {i}{s} THEN {w}{s} END' for s in range(SOURCES))}], lambda x: x IS NOT NULL)) END"


# A resumed source counts before its item is read (sub 0, never emitted); then the item itself (sub 1).
_WATERMARKS = f"""
, states AS (SELECT g, kind, src, merged_offset, {_STATES} FROM seq),
twice AS (SELECT *, {_BEFORE} FROM states),
steps AS (SELECT g, 0 AS sub, merged_offset, {_least('b', 'i')} AS least FROM twice WHERE ({' OR '.join(f'(d{s} AND NOT i{s})' for s in range(SOURCES))})
  UNION ALL SELECT g, 1, merged_offset, {_least('w', 'i')} FROM twice),
rising AS (SELECT *, max(least) OVER (ORDER BY g, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM steps),
emitted AS (SELECT merged_offset, least AS wm_ms FROM rising WHERE sub = 1 AND least IS NOT NULL AND (upto IS NULL OR least > upto))"""
_EMITTED = "SELECT merged_offset, wm_ms FROM emitted"



def _panes_sql(offset: int) -> str:
    """Live panes after ``offset`` records."""
    c, j = TUMBLING_LATE, offset // TUMBLING_LATE.interval
    return _sql(c, f"""SELECT k AS "key", s AS window_start_ms, s + {c.size} AS window_end_ms, sum(v)::BIGINT AS "sum", count(*) AS "count", any_value(fj >= 0 AND fj <= {j}) AS fired
FROM acc JOIN fires USING (s) WHERE o <= {offset} AND NOT (fj >= 0 AND fj <= {j} AND (SELECT wm FROM wm WHERE j = {j}) >= s + {c.size + c.lateness}) GROUP BY k, s""")


def _gen_sql(c: GeneratorConfig) -> str:
    """The generator's records by row numbers and the same arithmetic."""
    m = [int(x) for x in MULTIPLIERS]

    def draw(what: int, n: int) -> str:
        x = f"((o % {PRIME}) * {m[0]} + {c.seed % PRIME * m[1] + what * m[2]}) % {PRIME}"
        y = f"(({x}) * ({x}) + {what}) % {PRIME}"
        return f"((((({y}) * {m[3]} + ({x})) % {PRIME}) * ({y})) % {PRIME}) % {n}"

    moved = f"CASE WHEN {draw(2, 1_000_000)} < {int(c.late_fraction * 1_000_000)} THEN -({c.disorder + 1} + {draw(3, max(1, c.tail))}) ELSE -({draw(1, c.disorder + 1)}) END"
    return f"""SELECT o AS "offset", 'key-' || lpad(((o - 1) % {c.keys})::VARCHAR, 4, '0') AS "key", {draw(4, 1000)} + 1 AS "value",
greatest(0, (o - 1) * {c.step} + {moved})::BIGINT AS event_time_ms, ((o - 1) * {c.step})::BIGINT AS processing_time_ms FROM (SELECT unnest(range(1, {c.records + 1}))::BIGINT AS o)"""


SQL: dict[str, str] = {
    "gen_bounded": _gen_sql(BOUNDED),
    "gen_heavy_tailed": _gen_sql(HEAVY),
    "watermark_trajectory": _sql(TUMBLING, "SELECT j, wm AS wm_ms FROM wm"),
    "watermark_advances": _sql(TUMBLING, "SELECT j, wm AS wm_ms FROM adv"),
    "tumbling_sum_count": _sql(TUMBLING, _result("pairs", TUMBLING.size)),
    "sliding_sum_count": _sql(SLIDING, _result("pairs", SLIDING.size)),
    "hopping_gap": _sql(GAPS, _result("pairs", GAPS.size)),
    "late_drop_l0": _sql(TUMBLING, _result("acc", TUMBLING.size)),
    "late_drop_lpos": _sql(SLIDING_LATE, _result("acc", SLIDING_LATE.size)),
    "late_accepted": _sql(SLIDING_LATE, 'SELECT o AS "offset", s AS window_start_ms, rj AS refire_slot FROM late'),
    "window_fires": _sql(SLIDING_LATE, "SELECT s AS window_start_ms, fj AS slot FROM fires"),
    "window_refires": _sql(SLIDING_LATE, "SELECT DISTINCT s AS window_start_ms, rj AS slot FROM late"),
    "final_flush": _sql(SLIDING_LATE, "SELECT s AS window_start_ms, kind FROM em WHERE sl = -1"),
    "emission_changelog": _sql(SLIDING_LATE, 'SELECT sl AS slot, kind, k AS "key", s AS window_start_ms, total AS "sum", n AS "count" FROM log'),
    "authoritative_results": _sql(SLIDING_LATE, _result("acc", SLIDING_LATE.size)),
    "run_stats": _sql(SLIDING_LATE, f"SELECT (SELECT count(*) FROM st) AS records_processed, {_COUNTERS}, (SELECT count(*) FROM adv) AS watermarks_advanced, (SELECT count(*) FROM st) // {BARRIER} AS checkpoints_written"),
    "drop_contract": _sql(TUMBLING_LATE, "SELECT count(DISTINCT o) AS engine_dropped, count(DISTINCT o) AS predicted_dropped FROM judged WHERE dropped"),
    "min_watermark": _merge_sql(_WATERMARKS + _EMITTED, False),
    "min_watermark_idle": _merge_sql(_WATERMARKS + _EMITTED, True),
    "merge_sources": _merge_sql("""SELECT merged_offset, src, k AS "key", v AS "value", e AS event_time_ms FROM seq WHERE kind = 'r'""", False),
    "merge_idle": _merge_sql("""SELECT merged_offset, src, k AS "key", v AS "value", e AS event_time_ms FROM seq WHERE kind = 'r'""", True),
    "merged_late_drop": _merge_sql(
        _WATERMARKS
        + f""", rec AS (SELECT merged_offset, k, v, e // {6 * HOUR} * {6 * HOUR} AS s FROM seq WHERE kind = 'r'),
kept AS (SELECT rec.* FROM rec ASOF LEFT JOIN emitted ON rec.merged_offset > emitted.merged_offset WHERE wm_ms IS NULL OR wm_ms < s + {18 * HOUR})
"""
        + _result("kept", 6 * HOUR),
        False,
    ),
    "barrier_offsets": f"WITH {_STREAM} SELECT o // {BARRIER} AS epoch, o AS cut_offset FROM st WHERE o % {BARRIER} = 0",
    "aligned_cuts": f"WITH {_STREAM}, src AS (SELECT (event_id % 3)::INT AS src, row_number() OVER (PARTITION BY event_id % 3 ORDER BY o) AS so FROM st), ep AS (SELECT (so - 1) // (10 * (src + 1)) + 1 AS epoch, src, count(*) AS n FROM src GROUP BY 1, 2), whole AS (SELECT epoch, sum(n) AS n FROM ep WHERE n = 10 * (src + 1) GROUP BY 1 HAVING count(*) = 3) SELECT epoch, (sum(n) OVER (ORDER BY epoch))::BIGINT AS cut_offset FROM whole",
    "partition_assign": f"WITH {_STREAM}, n AS (SELECT unnest([1, 2, 4, 8]) AS n) SELECT k AS \"key\", n, ({_FNV} % n)::INT AS \"partition\" FROM (SELECT DISTINCT k FROM st), n",
    "partitioned_stats": " UNION ALL ".join(f"SELECT * FROM ({_sql(TUMBLING_LATE, f'SELECT {n} AS n, {_COUNTERS}', keyed=f'({_FNV} % {n})::INT')})" for n in (1, 2, 4)),
    "pane_snapshot_at": _panes_sql(SNAPSHOT),
    "snapshot_roundtrip": _panes_sql(SNAPSHOT),
    "torn_fallback": _panes_sql(SNAPSHOT - BARRIER),
    "restore_from_snapshot": _sql(TUMBLING_LATE, _result("acc", TUMBLING_LATE.size)),
    "merged_seek": _merge_sql(f"""SELECT merged_offset, src, k AS "key", v AS "value", e AS event_time_ms FROM seq WHERE kind = 'r' AND merged_offset > {SNAPSHOT}""", True),
    "merge_one": _sql(TUMBLING, 'SELECT o AS merged_offset, k AS "key", v AS "value", e AS event_time_ms, wm AS wm_ms FROM cut LEFT JOIN wm ON j = (o - 1) // 10'),
    "output_watermark": _sql(TUMBLING, f"SELECT j * 10 AS cut_offset, wm AS wm_ms FROM wm WHERE j * 10 % {BARRIER} = 0"),
    "restore_equivalence": _sql(TUMBLING_LATE, _result("acc", TUMBLING_LATE.size)),
    "recovery_union": _sql(TUMBLING_LATE, f"""SELECT k AS "key", s AS window_start_ms, s + {TUMBLING_LATE.size} AS window_end_ms, arg_max(total, n) AS "sum", max(n) AS "count", count(*) - 1 AS duplicates
FROM (SELECT * FROM log WHERE sl >= 0 AND sl <= {CRASH // 10} UNION ALL SELECT * FROM log WHERE sl < 0 OR sl > {SNAPSHOT // 10}) GROUP BY k, s"""),
    "highest_complete_checkpoint": f'WITH {_STREAM} SELECT max(o) AS "offset" FROM st WHERE o % {BARRIER} = 0 AND o < (SELECT max(o) FROM st WHERE o % {BARRIER} = 0)',
    "highest_partial_checkpoint": f'WITH {_STREAM} SELECT max(o) AS "offset" FROM st WHERE o % {BARRIER} = 0',
    "stop_at": _sql(TUMBLING_LATE, _result("acc", TUMBLING_LATE.size), stop=STOP),
    "seek_resume": _sql(TUMBLING_LATE, _result(f"(SELECT * FROM acc WHERE o > {SNAPSHOT})", TUMBLING_LATE.size)),
}
