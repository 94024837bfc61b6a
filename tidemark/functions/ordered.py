"""Ordered computations in two levels: inside buckets by partitioned windows, between buckets over one row for each.

No step orders all rows in one task; only the rows that stand for whole buckets are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A table of at most so many bytes (by the optimiser's estimate, from file sizes) is broadcast.
BROADCAST_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a frame's size, from file sizes and ranges; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(table: DataFrame, estimate: float) -> DataFrame:
    """``table`` with a broadcast hint if its estimated bytes allow it; else the join shuffles."""
    return F.broadcast(table) if estimate <= BROADCAST_BYTES else table


def running_max(rows: DataFrame, order: str, value: str, width: int = 4096) -> DataFrame:
    """``rows`` with upto, the greatest ``value`` up to a row in the order of ``order`` (whole numbers, distinct), and before, that of the rows before it.

    Buckets of ``width`` numbers are summed up first; only a row for each bucket is ordered as a whole.
    """
    rows = rows.withColumn("_b", F.floor(F.col(order) / width))
    tops = rows.groupBy("_b").agg(F.max(value).alias("_t"))
    earlier = F.max("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select("_b", earlier.alias("_p"))
    inside = Window.partitionBy("_b").orderBy(order)
    rows = rows.withColumn("_u", F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_w", F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    out = rows.join(tops, "_b")
    return out.withColumn("upto", F.greatest("_u", "_p")).withColumn("before", F.greatest("_w", "_p")).drop("_b", "_t", "_p", "_u", "_w")


def time_buckets(rows: DataFrame, column: str, width: int, least_bytes: int = 1 << 30, most_rows: int = 1 << 20) -> tuple[DataFrame, Column]:
    """``rows``, and a bucket for ``dense_offsets`` that follows ``column``: spans of ``width``, busy ones of large tables cut finer.

    Above ``least_bytes`` (estimated), rows are counted by span first, and a span is cut into as many equal parts as its
    rows ask for; the counts are a row for each span of the time that the table covers, so they are broadcast.
    """
    span = F.floor(F.col(column) / width)
    if estimated_bytes(rows) <= least_bytes:
        return rows, span
    counts = rows.groupBy(span.alias("_span")).agg(F.ceil(F.count("*") / most_rows).alias("_parts"))
    rows = rows.withColumn("_span", span).join(F.broadcast(counts), "_span")
    part = F.least(F.floor((F.col(column) - F.col("_span") * width) * F.col("_parts") / width), F.col("_parts") - 1)
    return rows.withColumn("_bucket", F.col("_span") * (1 << 20) + part).drop("_span", "_parts"), F.col("_bucket")


def dense_offsets(rows: DataFrame, bucket: Column, order: list[Column], name: str = "offset") -> DataFrame:
    """``rows`` with 1, 2, ... in the order of (bucket, *order); bucket must not fall where the order rises."""
    rows = rows.withColumn("_b", bucket)
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("_b", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return rows.join(base, "_b").withColumn(name, (F.col("_before") + within).cast("long")).drop("_b", "_before")


def carry_forward(rows: DataFrame, bucket: str, order: list[str], columns: dict[str, str], how: str = "last") -> DataFrame:
    """``rows`` with, for each (new name: column), the last value that is not null (or the greatest: "max") up to each row.

    bucket: a column that doesn't fall where the order rises.
    """
    of = (lambda c: F.last(c, ignorenulls=True)) if how == "last" else F.max
    inside = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", *(of(c).over(inside).alias(f"_in_{n}") for n, c in columns.items()), *(of(c).over(whole).alias(f"_end_{n}") for n, c in columns.items()))
    ends = rows.groupBy(bucket).agg(*(F.first(f"_end_{n}").alias(f"_e_{n}") for n in columns))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(bucket).alias("_bucket"), *(of(f"_e_{n}").over(before).alias(f"_p_{n}") for n in columns))
    join = (lambda a, b: F.coalesce(a, b)) if how == "last" else (lambda a, b: F.greatest(a, b))
    out = rows.join(ends, rows[bucket].eqNullSafe(F.col("_bucket"))).withColumns({n: join(F.col(f"_in_{n}"), F.col(f"_p_{n}")) for n in columns})
    return out.drop("_bucket", *(f"{p}{n}" for n in columns for p in ("_in_", "_end_", "_p_")))


def next_point(queries: DataFrame, query: str, points: DataFrame, point: str, width: int, name: str) -> DataFrame:
    """Each distinct value of ``query`` with the payload of the least point at or after it (null if there is none).

    points: (point, payload), points distinct. width: of the buckets that values fall into.
    """
    asked = queries.select(F.col(query).alias("_v")).where("_v is not null").distinct()
    rows = points.select(F.col(point).alias("_v"), F.col("payload").alias("_p")).union(asked.select("_v", F.lit(None).cast("long")))
    rows = rows.withColumn("_b", -F.floor(F.col("_v") / width)).withColumn("_k", -F.col("_v")).withColumn("_q", F.col("_p").isNull())
    out = carry_forward(rows, "_b", ["_k", "_q"], {name: "_p"})
    return out.where("_q").select(F.col("_v").alias(query), name)
