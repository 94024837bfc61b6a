"""A replayable stream of records as a Python data source: offsets, admission, seeking, and probes of a running query.

``Records`` is the seam: anything that can tell its end and give the records of an offset range is a source. The format
``tidemark_records`` turns one into a streaming reader: each micro-batch admits ``batch`` records, offsets are record
numbers, ``start`` seeks, ``stop`` ends the stream early. Spark logs the offsets of each batch, so a restart replays the
same ranges; and since a range's records are a function of it, it replays the same records.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.sources.generator import GeneratorConfig, record

SCHEMA = "offset long, key string, value long, event_time_ms long, processing_time_ms long"


class Records(Protocol):
    def end(self) -> int:
        """The number of the last record there is."""

    def read(self, after: int, upto: int) -> Iterator[tuple]:
        """The records (SCHEMA) numbered after + 1 to upto."""


class Generated:
    """The generator's records, each made from its number alone."""

    def __init__(self, config: GeneratorConfig) -> None:
        self.config = config

    def end(self) -> int:
        return self.config.records

    def read(self, after: int, upto: int) -> Iterator[tuple]:
        return (record(self.config, o) for o in range(after + 1, upto + 1))


class Scripted:
    """Records written down by hand: (key, value, event time)."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        self.rows = rows

    def end(self) -> int:
        return len(self.rows)

    def read(self, after: int, upto: int) -> Iterator[tuple]:
        return ((o, k, v, e, e) for o, (k, v, e) in enumerate(self.rows[after:upto], after + 1))


class Stopping:
    """The first ``most`` records of another source; seeking starts the count anew where it is asked for from there."""

    def __init__(self, source: Records, most: int) -> None:
        self.source, self.most = source, most

    def end(self) -> int:
        return min(self.most, self.source.end())

    def read(self, after: int, upto: int) -> Iterator[tuple]:
        return self.source.read(after, min(upto, self.end()))


class Flushed:
    """All of another source and one record far ahead, which stands for the final flush that streams don't have."""

    def __init__(self, source: Records) -> None:
        self.source = source

    def end(self) -> int:
        return self.source.end() + 1

    def read(self, after: int, upto: int) -> Iterator[tuple]:
        yield from self.source.read(after, min(upto, self.source.end()))
        if after < self.end() <= upto:
            yield (self.end(), "flush", 0, 1 << 40, 1 << 40)


class _Range(InputPartition):
    def __init__(self, after: int, upto: int) -> None:
        self.after, self.upto = after, upto


class RecordReader(DataSourceStreamReader):
    def __init__(self, source: Records, start: int, batch: int, split: int) -> None:
        self.source, self.start, self.batch, self.split = source, start, batch, split
        self.admitted: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        """One more batch than last time. After a restart, the first call says where the log left off; it starts from ``partitions``."""
        at = self.start if self.admitted is None else self.admitted
        self.admitted = min(self.source.end(), at + self.batch)
        return {"offset": self.admitted}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["offset"], end["offset"]
        self.admitted = max(b, self.admitted or 0)
        return [_Range(x, min(b, x + self.split)) for x in range(a, b, self.split)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        return self.source.read(partition.after, partition.upto)


def _named(options: dict[str, str]) -> Records:
    """The source that options name: script (a JSON list of key, value, event time), or else the generator's settings."""
    if "script" in options:
        source: Records = Scripted([tuple(r) for r in json.loads(options["script"])])
    else:
        kinds = GeneratorConfig.__dataclass_fields__
        lower = {k.lower(): k for k in kinds}
        given = {lower[k]: (float(v) if lower[k] == "late_fraction" else int(v)) for k, v in options.items() if k in lower}
        source = Generated(GeneratorConfig(**given))
    if "stop" in options:
        source = Stopping(source, int(options["stop"]))
    return Flushed(source) if "flush" in options else source


class RecordSource(DataSource):
    """Options: the fields of GeneratorConfig or script; start, stop, flush, batch (records of a micro-batch), split (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_records"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: Any) -> RecordReader:  # noqa: N802
        o = {k.lower(): v for k, v in self.options.items()}
        return RecordReader(_named(o), int(o.get("start", 0)), int(o.get("batch", 1000)), int(o.get("split", 100_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)


class ProgressProbe(StreamingQueryListener):
    """Writes the state of a query after each batch (number, rows, end offsets, watermark) to a marker file, whole or not at all.

    The offsets of a batch over several sources are its aligned cut, so a watcher knows where a kill falls.
    """

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        p = event.progress
        state = {"batch": p.batchId, "rows": p.numInputRows, "ends": [json.loads(s.endOffset) if s.endOffset else None for s in p.sources], "watermark": dict(p.eventTime or {}).get("watermark")}
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps(state))
        part.replace(self.path)

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        pass
