"""A deterministic generator of disordered event streams, by columns of ``spark.range``.

Each record is a function of (seed, offset) alone, so any offset can be sought without replay. Null-free by construction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GeneratorConfig:
    """late_fraction: the share of records pushed past ``disorder`` by up to ``tail`` ms; 0 keeps all within it."""

    records: int = 10_000
    keys: int = 5
    step: int = 1
    disorder: int = 500
    late_fraction: float = 0.0
    tail: int = 6000
    seed: int = 42


# The Mersenne prime 2**31 - 1 and multipliers that generate the residues modulo it.
PRIME = 2_147_483_647
MULTIPLIERS = (48_271, 69_621, 16_807, 39_373)


def _draw(seed: int, what: int, n: int) -> Column:
    """A number below n from (seed, what, offset): plain arithmetic modulo a prime, so that any engine can repeat it."""
    a, b, c, d = MULTIPLIERS
    x = ((F.col("offset") % PRIME) * a + (seed % PRIME) * b + what * c) % PRIME
    y = (x * x + what) % PRIME
    return ((y * d + x) % PRIME * y % PRIME) % n


def generate(spark: SparkSession, config: GeneratorConfig, start: int = 0) -> DataFrame:
    """offset (1-based), key, value, event_time_ms, processing_time_ms of the records after ``start``."""
    c = config
    rows = spark.range(start + 1, c.records + 1).withColumnRenamed("id", "offset")
    base = (F.col("offset") - 1) * c.step
    jitter = -_draw(c.seed, 1, c.disorder + 1)
    late = -(c.disorder + 1 + _draw(c.seed, 3, max(1, c.tail)))
    pushed = F.when(_draw(c.seed, 2, 1_000_000) < int(c.late_fraction * 1_000_000), late).otherwise(jitter)
    return rows.select(
        "offset",
        F.format_string("key-%04d", (F.col("offset") - 1) % c.keys).alias("key"),
        (_draw(c.seed, 4, 1000) + 1).alias("value"),
        F.greatest(F.lit(0), base + pushed).cast("long").alias("event_time_ms"),
        base.cast("long").alias("processing_time_ms"),
    )


def record(config: GeneratorConfig, offset: int) -> tuple[int, str, int, int, int]:
    """What ``generate`` gives for one offset, in Python."""
    c = config
    base = (offset - 1) * c.step

    def draw(what: int, n: int) -> int:
        m = MULTIPLIERS
        x = ((offset % PRIME) * m[0] + (c.seed % PRIME) * m[1] + what * m[2]) % PRIME
        y = (x * x + what) % PRIME
        return ((y * m[3] + x) % PRIME * y % PRIME) % n

    late = draw(2, 1_000_000) < int(c.late_fraction * 1_000_000)
    moved = -(c.disorder + 1 + draw(3, max(1, c.tail))) if late else -draw(1, c.disorder + 1)
    return offset, f"key-{(offset - 1) % c.keys:04d}", draw(4, 1000) + 1, max(0, base + moved), base


def live_panes(spark: SparkSession, records: int, keys: int, interval: int, size: int = 1 << 40) -> tuple[DataFrame, DataFrame]:
    """Records (offset, key, value, e) of ``keys`` keys in one window that never ends, and a watermark (j, wm) that rises every ``interval``."""
    rows = spark.range(1, records + 1).select(F.col("id").alias("offset"), F.format_string("key-%08d", F.col("id") % keys).alias("key"), F.lit(1).cast("long").alias("value"), F.pmod("id", F.lit(size)).alias("e"))
    return rows, spark.range(1, records // interval + 1).select(F.col("id").alias("j"), F.col("id").alias("wm"))
