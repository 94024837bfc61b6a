"""What a stream is here: a table with a dense total order, and the numbers that govern its windows.

A record has offset (1, 2, ... in stream order), key, value and e (event time in epoch milliseconds, at least 0).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

HOUR = 3_600_000
#: Slot of what is emitted when the stream has ended, after every watermark.
END = 1 << 62


@dataclass(frozen=True)
class StreamConfig:
    """interval: records between watermarks. disorder: how far a watermark stays behind the latest event. Times in ms."""

    size: int = 6 * HOUR
    slide: int = 0
    lateness: int = 0
    interval: int = 10
    disorder: int = HOUR

    @property
    def step(self) -> int:
        return self.slide or self.size

    def with_(self, **changes: int) -> StreamConfig:
        return replace(self, **changes)


RECORD = "key string, value long, event_time_ms long, processing_time_ms long"
RESULT = ("key", "window_start_ms", "window_end_ms", "sum", "count")
