"""Every catalogue query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import checkpoint
from tidemark.queries import QUERIES, SQL
from tidemark.sources import tables

SF = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(str(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.sql(SQL[name]).df())


def counted(spark):
    """An accumulator, and a condition that is always true and adds each row that it sees to it."""
    seen = spark.sparkContext.accumulator(0)
    return seen, F.udf(lambda _: seen.add(1) or True, "boolean").asNondeterministic()("offset")


def test_snapshots_of_partitions_take_the_state_once(spark, monkeypatch):
    stream, panes_at, pairs = tables.event_stream, checkpoint.panes_at, []
    (records, record), (summed, pair) = counted(spark), counted(spark)

    def panes(rows, *more):
        pairs.append(rows.count())
        return panes_at(rows.where(pair), *more)

    monkeypatch.setattr(tables, "event_stream", lambda *a: stream(*a).where(record))
    monkeypatch.setattr(checkpoint, "panes_at", panes)
    assert QUERIES["highest_complete_checkpoint"](spark, SF).first().offset == 900
    assert records.value == 1000 and len(pairs) == 2 and summed.value == sum(pairs)


@pytest.mark.parametrize("events", [0, 50, 150, 250])
def test_checkpoints_of_short_streams(spark, tmp_path, events):
    db = duckdb.connect()
    db.sql(f"COPY (SELECT * FROM '{SF}/events.parquet' ORDER BY event_id LIMIT {events}) TO '{tmp_path}/events.parquet'")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("highest_complete_checkpoint", "highest_partial_checkpoint"):
        assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()] == db.sql(SQL[name]).fetchall()
