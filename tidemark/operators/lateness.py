"""Late records: which pairs of record and window are dropped, and the result of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import StreamConfig
from tidemark.operators.watermark import in_force, trajectory
from tidemark.operators.windows import assign_windows


def classify(stream: DataFrame, wms: DataFrame, config: StreamConfig) -> DataFrame:
    """A row for each record and window with slot, wm_in and dropped."""
    return mark_dropped(assign_windows(in_force(stream, wms, config), config), config)


def mark_dropped(pairs: DataFrame, config: StreamConfig) -> DataFrame:
    """``pairs`` (s, wm_in) with dropped: the watermark in force has reached the window's end and the allowed lateness."""
    gone = F.col("wm_in") >= F.col("s") + config.size + config.lateness
    return pairs.withColumn("dropped", F.coalesce(gone, F.lit(False)))


def accepted(stream: DataFrame, config: StreamConfig) -> DataFrame:
    """The pairs of record and window that count."""
    return classify(stream, trajectory(stream, config), config).where(~F.col("dropped"))
