"""What is emitted when: first fires, re-fires, the changelog of results, and the statistics of a run.

Slots are numbers j of watermarks; END stands for the final flush. Fires belong to whole windows: ``group`` names the
columns that tell windows apart (s, or partition and s where each partition fires on its own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ordered import next_point
from tidemark.model import END, StreamConfig

_SLOTS = 4096


def first_fires(pairs: DataFrame, adv: DataFrame, config: StreamConfig, group: list[str] | None = None) -> DataFrame:
    """group, fire: the first strict advance after a window's first accepted record that reaches the window's end."""
    group = group or ["s"]
    firsts = pairs.groupBy(*group).agg(F.min("offset").alias("o"))
    firsts = firsts.withColumn("end", F.col("s") + config.size).withColumn("least", F.ceil(F.col("o") / config.interval))
    by_time = next_point(firsts, "end", adv.select("wm", F.col("j").alias("payload")), "wm", config.step, "reached")
    firsts = firsts.join(by_time, "end").withColumn("from", F.greatest("reached", "least"))
    by_slot = next_point(firsts.where("reached is not null"), "from", adv.select("j", F.col("j").alias("payload")), "j", _SLOTS, "fire")
    return firsts.withColumn("from", F.when(F.col("reached").isNotNull(), F.col("from"))).join(by_slot, "from", "left").select(*group, F.coalesce("fire", F.lit(END)).alias("fire"))


def late_accepted(pairs: DataFrame, fires: DataFrame, adv: DataFrame, group: list[str] | None = None) -> DataFrame:
    """The accepted pairs whose window had fired already, with refire: the next strict advance."""
    group = group or ["s"]
    late = pairs.join(fires, group).where(F.col("fire") <= F.col("slot")).withColumn("after", F.col("slot") + 1)
    slots = next_point(late, "after", adv.select("j", F.col("j").alias("payload")), "j", _SLOTS, "refire")
    return late.join(slots, "after").withColumn("refire", F.coalesce("refire", F.lit(END))).drop("after")


def emission_slots(fires: DataFrame, late: DataFrame) -> DataFrame:
    """s, at, kind: every emission of a window."""
    first = fires.select("s", F.col("fire").alias("at"), F.lit("fire").alias("kind"))
    return first.union(late.select("s", F.col("refire").alias("at"), F.lit("refire").alias("kind")).distinct())


def changelog(pairs: DataFrame, emissions: DataFrame, config: StreamConfig) -> DataFrame:
    """at, kind, key, s, sum, count: at each emission every key of the window with all it has accepted so far.

    Records are summed by (window, key, interval) first; each sum joins the next emission of its window, and running
    sums over a key's emissions give the rows.
    """
    parts = pairs.groupBy("s", "key", F.ceil(F.col("offset") / config.interval).alias("c")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    marks = emissions.select("s", F.col("at").alias("x"), F.col("at").alias("to")).union(parts.select("s", F.col("c"), F.lit(None).cast("long")).distinct())
    order = Window.partitionBy("s").orderBy(F.desc("x"), F.col("to").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("at", F.last("to", ignorenulls=True).over(order)).where("to is null").select("s", F.col("x").alias("c"), "at")
    added = parts.join(marks, ["s", "c"]).groupBy("s", "key", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    rows = added.select("s", "key").distinct().join(emissions, "s").join(added, ["s", "key", "at"], "left")
    so_far = Window.partitionBy("s", "key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("v").over(so_far)).withColumn("count", F.sum("n").over(so_far))
    return rows.where("count > 0").select("at", "kind", "key", "s", "sum", "count")


def authoritative(log: DataFrame, config: StreamConfig) -> DataFrame:
    """For each key and window the emission of most records: the result."""
    out = log.groupBy("key", "s").agg(F.max(F.struct("count", "sum")).alias("r"))
    return out.select("key", F.col("s").alias("window_start_ms"), (F.col("s") + config.size).alias("window_end_ms"), "r.sum", "r.count")


def shown(slot: str) -> Column:
    """A slot as shown in results: END is -1."""
    return F.when(F.col(slot) == END, F.lit(-1)).otherwise(F.col(slot)).cast("long")
