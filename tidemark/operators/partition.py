"""Keyed parallelism: which of n partitions a key belongs to, by FNV-1a, so that results never depend on n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.hashing import fnv1a_column, unsigned_mod
from tidemark.model import StreamConfig
from tidemark.operators.windows import sum_count


def partition_of(key: Column, n: int) -> Column:
    """FNV-1a of the key modulo n."""
    return unsigned_mod(fnv1a_column(key), n).cast("int")


def with_partition(rows: DataFrame, n: int, name: str = "p") -> DataFrame:
    """``rows`` with the partition of their key; keys are hashed once each.

    What is hashed depends on an aggregate: the optimiser would push a filter by partition below a plain ``distinct``,
    and over the join, where it hashes the key of every row.
    """
    keys = rows.groupBy("key").agg(F.count("*").alias("_n"))
    keys = keys.select("key", partition_of(F.when(F.col("_n") > 0, F.col("key")), n).alias(name))
    return rows.join(keys, "key")


def partitioned_sum_count(pairs: DataFrame, n: int, config: StreamConfig) -> DataFrame:
    """``sum_count`` dealt to n partitions by key, with p: summed before keys are routed, so a shuffle carries sums and no records."""
    return with_partition(sum_count(pairs, config), n).repartition(n, "p")
