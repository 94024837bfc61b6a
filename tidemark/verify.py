"""Verification as an API: compare results, and hold the engine against the oracle over seeds, partitions and sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import oracle
from tidemark.model import StreamConfig
from tidemark.operators import emissions, lateness, merge, partition, watermark, windows
from tidemark.sources.generator import GeneratorConfig, generate

SECOND = 1000
#: Window shapes, lateness and disorder of the matrix that ``matrix`` runs.
SHAPES = {"tumbling": (SECOND, 0), "sliding": (2 * SECOND, SECOND)}
LATENESS = {"L=0": 0, "L=2s": 2 * SECOND}
DISORDER = {"bounded": 0.0, "heavy": 0.1}


def compare_results(engine: DataFrame, expected: DataFrame) -> DataFrame:
    """key, window_start_ms, problem (missing, extra, sum or count) of each result that differs; nulls are equal to nulls.

    Both have the result columns, a row for each key and window. Equal results give no row.
    """
    keys = ["key", "window_start_ms"]
    a, b = (x.select(*keys, F.col("sum").alias(f"{n}_sum"), F.col("count").alias(f"{n}_count"), F.lit(True).alias(n)) for x, n in ((engine, "engine"), (expected, "expected")))
    both = a.join(b, keys, "full_outer")
    problem = (
        F.when(F.col("engine").isNull(), "missing").when(F.col("expected").isNull(), "extra")
        .when(~F.col("engine_count").eqNullSafe(F.col("expected_count")), "count").when(~F.col("engine_sum").eqNullSafe(F.col("expected_sum")), "sum")
    )
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


@dataclass(frozen=True)
class Finding:
    """One comparison: how many results differ, and the counters of both sides."""

    name: str
    mismatches: int
    results: int
    engine_dropped: int
    oracle_dropped: int
    late: int
    refired: int

    @property
    def passed(self) -> bool:
        return self.mismatches == 0 and self.engine_dropped == self.oracle_dropped


def _expected(spark: SparkSession, found: oracle.Outcome, config: StreamConfig) -> DataFrame:
    rows = [(k, s, s + config.size, total, count) for (k, s), (total, count) in found.results.items()]
    return spark.createDataFrame(rows, "key string, window_start_ms long, window_end_ms long, sum long, count long")


def _records(stream: DataFrame) -> list[oracle.Record]:
    """The oracle's input: whole streams of the sizes that tests use."""
    return [(r.offset, r.key, r.value, r.e) for r in stream.orderBy("offset").select("offset", "key", "value", "e").collect()]


def _finding(spark: SparkSession, name: str, pairs: DataFrame, wms: DataFrame, found: oracle.Outcome, config: StreamConfig) -> Finding:
    engine = windows.sum_count(pairs.where(~F.col("dropped")), config)
    differ = compare_results(engine, _expected(spark, found, config)).count()
    dropped = pairs.where("dropped").agg(F.countDistinct("offset").alias("n")).first().n
    return Finding(name, differ, len(found.results), dropped, len(found.dropped), len(found.late), found.refired)


def run_differential(spark: SparkSession, seeds: range, config: StreamConfig, generator: GeneratorConfig) -> list[Finding]:
    """The engine's plan against the oracle, seed by seed."""
    out = []
    for seed in seeds:
        stream = generate(spark, GeneratorConfig(**{**generator.__dict__, "seed": seed})).withColumnRenamed("event_time_ms", "e")
        wms = watermark.trajectory(stream, config)
        out.append(_finding(spark, f"seed {seed}", lateness.classify(stream, wms, config), wms, oracle.run(_records(stream), config), config))
    return out


def run_cross_n(spark: SparkSession, seeds: range, config: StreamConfig, generator: GeneratorConfig, ns: tuple[int, ...] = (1, 2, 4, 8)) -> list[Finding]:
    """The same results whatever the number of partitions, in the plan and in the session."""
    out, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for seed in seeds:
            stream = generate(spark, GeneratorConfig(**{**generator.__dict__, "seed": seed})).withColumnRenamed("event_time_ms", "e")
            found = oracle.run(_records(stream), config)
            want = _expected(spark, found, config)
            for n in ns:
                spark.conf.set("spark.sql.shuffle.partitions", str(n))
                pairs = lateness.classify(stream, watermark.trajectory(stream, config), config)
                engine = partition.partitioned_sum_count(pairs.where(~F.col("dropped")), n, config)
                dropped = pairs.where("dropped").agg(F.countDistinct("offset").alias("n")).first().n
                out.append(Finding(f"seed {seed}, N={n}", compare_results(engine, want).count(), len(found.results), dropped, len(found.dropped), len(found.late), found.refired))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return out


def source_generators(generator: GeneratorConfig, k: int) -> list[GeneratorConfig]:
    """Settings of k sources: seeds apart from each other, the first the fastest in event time."""
    return [GeneratorConfig(**{**generator.__dict__, "seed": generator.seed + 7919 * i, "step": k - i}) for i in range(k)]


def run_multi_source(spark: SparkSession, seeds: range, k: int, config: StreamConfig, generator: GeneratorConfig, idle: tuple[merge.IdleSpan, ...] = (), n: int = 1) -> list[Finding]:
    """A merged stream of k sources: order, combined watermarks and results against a turn-by-turn merge; n partitions."""
    out = []
    for seed in seeds:
        parts = source_generators(GeneratorConfig(**{**generator.__dict__, "seed": seed}), k)
        frames = [generate(spark, g).withColumnRenamed("event_time_ms", "e").select(F.lit(i).alias("src"), F.col("offset").alias("src_offset"), "key", "value", "e") for i, g in enumerate(parts)]
        sources = frames[0]
        for f in frames[1:]:
            sources = sources.union(f)
        stream = merge.merge_sources(sources, k, config, idle).withColumn("offset", F.col("merged_offset"))
        wms = merge.combined_watermark(sources, k, config, idle)
        rows = merge.with_watermark(stream, wms)
        pairs = lateness.mark_dropped(windows.assign_windows(rows, config), config)
        lists = [[(r.src_offset, r.key, r.value, r.e) for r in f.orderBy("src_offset").collect()] for f in frames]
        spans = [[(x.start, x.length) for x in idle if x.src == i] for i in range(k)]
        order, marks, _ = oracle.merge(lists, config, spans, idle[0].timeout if idle else 30)
        found = oracle.run([(o, r[1], r[2], r[3]) for o, (_, r) in enumerate(order, 1)], config, marks)
        finding = _finding(spark, f"seed {seed}, K={k}, N={n}", partition.with_partition(pairs, n) if n > 1 else pairs, wms, found, config)
        if {r.merged_offset: r.wm_ms for r in wms.collect()} != marks:
            finding = Finding(**{**finding.__dict__, "mismatches": finding.mismatches + 1})
        out.append(finding)
    return out


def matrix(spark: SparkSession, seeds: range, records: int = 10_000) -> dict[str, list[Finding]]:
    """All window shapes, latenesses and disorders."""
    out = {}
    for shape, (size, slide) in SHAPES.items():
        for late, allowed in LATENESS.items():
            for disorder, fraction in DISORDER.items():
                config = StreamConfig(size, slide=slide, lateness=allowed, interval=100, disorder=500)
                out[f"{shape}, {late}, {disorder}"] = run_differential(spark, seeds, config, GeneratorConfig(records=records, keys=10, late_fraction=fraction))
    return out


def emitted_once(spark: SparkSession, stream: DataFrame, config: StreamConfig) -> int:
    """How many (key, window) are emitted more than once in the raw changelog; none must be without allowed lateness."""
    wms = watermark.trajectory(stream, config)
    pairs = lateness.classify(stream, wms, config).where(~F.col("dropped"))
    adv = watermark.advances(wms)
    fires = emissions.first_fires(pairs, adv, config)
    log = emissions.changelog(pairs, emissions.emission_slots(fires, emissions.late_accepted(pairs, fires, adv)), config)
    return log.groupBy("key", "s").count().where("count > 1").count()
