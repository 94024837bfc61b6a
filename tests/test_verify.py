"""The engine against the oracle, and the comparator against mutations."""

import pytest

from tidemark import verify
from tidemark.model import StreamConfig
from tidemark.operators.merge import IdleSpan
from tidemark.sources.generator import GeneratorConfig, generate

HEAVY = GeneratorConfig(records=1500, keys=10, step=10, late_fraction=0.1)
LATE = StreamConfig(1000, lateness=2000, interval=50, disorder=500)


def test_comparator_catches_mutations(spark):
    rows = [("a", 0, 1000, 5, 2), ("b", 0, 1000, 7, 1), (None, 1000, 2000, None, 0)]
    frame = lambda x: spark.createDataFrame(x, "key string, window_start_ms long, window_end_ms long, sum long, count long")
    problems = lambda x: sorted(r.problem for r in verify.compare_results(frame(x), frame(rows[:2])).collect())
    assert problems(rows[:2]) == []
    assert problems(rows[:1]) == ["missing"]
    assert problems(rows) == ["extra"]
    assert problems([("a", 0, 1000, 6, 2), rows[1]]) == ["sum"]
    assert problems([("a", 0, 1000, 5, 3), rows[1]]) == ["count"]


@pytest.mark.parametrize("slide", [0, 400])
@pytest.mark.parametrize("lateness", [0, 2000])
def test_differential(spark, slide, lateness):
    found = verify.run_differential(spark, range(1, 3), LATE.with_(slide=slide, lateness=lateness), HEAVY)
    assert all(f.passed for f in found)
    assert sum(f.engine_dropped for f in found) > 0
    assert (sum(f.refired for f in found) > 0) == (lateness > 0)


def test_cross_n(spark):
    found = verify.run_cross_n(spark, range(3, 4), LATE, HEAVY)
    assert len(found) == 4 and all(f.passed and f.results for f in found)


@pytest.mark.parametrize(("k", "idle"), [(1, ()), (3, (IdleSpan(2, 100, 200, 30), IdleSpan(2, 600, 80, 30), IdleSpan(1, 50, 90, 30)))])
def test_sources(spark, k, idle):
    assert all(f.passed for f in verify.run_multi_source(spark, range(4, 5), k, LATE, HEAVY, idle, n=2))


def test_nothing_is_emitted_twice_without_lateness(spark):
    stream = generate(spark, HEAVY).withColumnRenamed("event_time_ms", "e")
    assert verify.emitted_once(spark, stream, LATE.with_(lateness=0)) == 0
    assert verify.emitted_once(spark, stream, LATE) > 0
