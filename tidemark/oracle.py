"""An independent oracle: the engine's rules over a list of records, one after another, in plain Python.

It shares no code with the plans: windows are found by walking back from the last start, state is held in dictionaries.
For checks only; it holds a whole stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from tidemark.model import StreamConfig

Record = tuple[int, str, int, int]  # offset, key, value, event time in ms


@dataclass
class Outcome:
    """results: (key, window start) -> (sum, count) of all accepted records."""

    results: dict[tuple[str, int], tuple[int, int]] = field(default_factory=dict)
    dropped: set[int] = field(default_factory=set)
    late: set[int] = field(default_factory=set)
    fired: int = 0
    refired: int = 0


def windows_of(e: int, config: StreamConfig) -> list[int]:
    out, start = [], e - e % config.step
    while start >= 0 and start + config.size > e:
        out.append(start)
        start -= config.step
    return out


def run(records: Iterable[Record], config: StreamConfig, watermarks: dict[int, int] | None = None) -> Outcome:
    """What the engine must find. watermarks: those emitted after an offset, if not by the stream itself."""
    out = Outcome()
    top, now = None, None
    fired: set[int] = set()
    again: set[int] = set()

    def rise(wm: int) -> None:
        nonlocal now
        if now is not None and wm <= now:
            return
        now = wm
        for s in {s for _, s in out.results} - fired:
            if s + config.size <= wm:
                fired.add(s)
                out.fired += 1
        out.refired += len(again)
        again.clear()

    for n, (offset, key, value, e) in enumerate(records, 1):
        top = e if top is None else max(top, e)
        for s in windows_of(e, config):
            if now is not None and now >= s + config.size + config.lateness:
                out.dropped.add(offset)
                continue
            total, count = out.results.get((key, s), (0, 0))
            out.results[key, s] = (total + value, count + 1)
            if s in fired:
                again.add(s)
                out.late.add(offset)
        if watermarks is None and n % config.interval == 0:
            rise(max(0, top - config.disorder))
        elif watermarks is not None and offset in watermarks:
            rise(watermarks[offset])
    out.refired += len(again)
    out.fired += len({s for _, s in out.results} - fired)
    return out


def merge(sources: list[list[Record]], config: StreamConfig, spans: list[list[tuple[int, int]]] | None = None, timeout: int = 30, barriers: list[int] | None = None) -> tuple[list[tuple[int, Record]], dict[int, int], list[int]]:
    """A round-robin merge, a turn at a time: ((source, record) in merged order, watermarks by merged offset, aligned cuts).

    spans: (start record, length in turns) for each source. barriers: each source's interval of barriers, 0 for none.
    """
    k = len(sources)
    feeds = [_feed(s, config, gaps, every) for s, gaps, every in zip(sources, spans or [[]] * k, barriers or [0] * k, strict=True)]
    marks: list[int | None] = [None] * k
    idle, over = [False] * k, [False] * k
    delivered, empty = [0] * k, [0] * k
    order: list[tuple[int, Record]] = []
    watermarks: dict[int, int] = {}
    cuts: list[int] = []
    now: int | None = None

    def combine(may_emit: bool = True) -> None:
        nonlocal now
        live = [m for m, out in zip(marks, idle, strict=True) if not out]
        if live and None not in live and (now is None or min(live) > now):
            now = min(live)
            if may_emit:
                watermarks[len(order)] = now

    def close() -> None:
        live = [i for i in range(k) if not idle[i] and not over[i]]
        if live and all(delivered[i] > len(cuts) for i in live):
            cuts.append(len(order))

    ring = list(range(k))
    while True:
        at = next((n for n, i in enumerate(ring) if not over[i] and delivered[i] <= len(cuts)), None)
        if at is None:
            return order, watermarks, cuts
        i = ring[at]
        ring = ring[at + 1 :] + ring[: at + 1]
        kind, item = next(feeds[i], ("end", None))
        if kind == "end":
            over[i] = True
            close()
            continue
        if kind == "tick":
            empty[i] += 1
            if empty[i] >= timeout and not idle[i]:
                idle[i] = True
                combine()
                close()
            continue
        empty[i] = 0
        if idle[i]:
            idle[i] = False
            combine(may_emit=False)
        if kind == "record":
            order.append((i, item))
        elif kind == "watermark":
            marks[i] = max(item, marks[i] or 0)
            combine()
        else:
            delivered[i] += 1
            close()


def _feed(records: list[Record], config: StreamConfig, gaps: list[tuple[int, int]], every: int) -> Iterator[tuple[str, Any]]:
    """What one source gives, item by item."""
    length, top = dict(gaps), 0
    for _ in range(length.get(0, 0)):
        yield "tick", None
    for n, record in enumerate(records, 1):
        yield "record", record
        top = max(top, record[3])
        for _ in range(length.get(n, 0)):
            yield "tick", None
        if n % config.interval == 0:
            yield "watermark", max(0, top - config.disorder)
        if every and n % every == 0:
            yield "barrier", n
