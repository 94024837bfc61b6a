"""Media columns in MPEG transport streams.

A payload is stored as one elementary stream of private data: it is cut into access units, each a PES packet with a
presentation time stamp, and these into transport packets of 188 bytes. Programme tables (PAT and PMT, with their CRC)
stand at the start and again before every eighth unit. Each unit's first packet carries a clock reference and is marked
as a random-access point, so a reader can start there.

``parse`` reads such bytes without other knowledge: it follows PAT and PMT to the stream, checks continuity counters,
reassembles the PES packets and gives their payloads, time stamps and the byte positions of random-access points.

Null texts are stored as empty ones. Equal texts give equal streams, so repeated rows have equal values; very long texts
make longer streams, one document in memory at a time; columns but doc_id and text are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow

PACKET = 188
PAT_PID, PMT_PID, STREAM_PID = 0x0000, 0x1000, 0x0100
PRIVATE_DATA = 0x06
UNIT = 192 * 64
TICKS = 3600  # of 90 kHz between units
FIRST_TIME = 90_000
TABLES_EVERY = 8


def _section_crc(data: bytes) -> int:
    """CRC-32 of programme tables: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


@cache
def _tables(counter: int) -> bytes:
    """A PAT packet and a PMT packet."""

    def packet(pid: int, table: int, number: int, body: bytes) -> bytes:
        head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
        section = head + body
        section += struct.pack(">I", _section_crc(section))
        out = struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10 | counter) + b"\0" + section
        return out.ljust(PACKET, b"\xff")

    pat = packet(PAT_PID, 0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
    pmt = packet(PMT_PID, 0x02, 1, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, PRIVATE_DATA, 0xE000 | STREAM_PID, 0xF000))
    return pat + pmt


def _time_bytes(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE])


def _unit(payload: bytes, time: int, counter: int) -> np.ndarray:
    """Transport packets of one access unit."""
    pes = b"\0\0\x01\xbd" + struct.pack(">HBBB", len(payload) + 8, 0x84, 0x80, 5) + _time_bytes(time) + payload
    n = 1 + max(0, -(-(len(pes) - 176) // 184))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0] = 0x47
    out[:, 1] = STREAM_PID >> 8
    out[0, 1] |= 0x40
    out[:, 2] = STREAM_PID & 0xFF
    out[:, 3] = 0x10 | ((counter + np.arange(n)) & 0x0F)
    clock = (time - 9000) % (1 << 33)
    out[0, 3] |= 0x20
    out[0, 5:12] = np.frombuffer(bytes([0x50]) + struct.pack(">IH", clock >> 1, (clock & 1) << 15 | 0x7E00), np.uint8)
    body = np.frombuffer(pes, np.uint8)
    if n == 1:
        out[0, 4] = 183 - len(body)
        out[0, PACKET - len(body) :] = body
        return out
    out[0, 4] = 7
    out[0, 12:] = body[:176]
    full = (len(body) - 176) // 184
    out[1 : 1 + full, 4:] = body[176 : 176 + 184 * full].reshape(full, 184)
    rest = body[176 + 184 * full :]
    if len(rest):
        stuffing = 184 - len(rest)
        out[-1, 3] |= 0x20
        out[-1, 4] = stuffing - 1
        if stuffing > 1:
            out[-1, 5] = 0x00
        out[-1, PACKET - len(rest) :] = rest
    return out


def store(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    parts, counter, tables = [], 0, 0
    for k, i in enumerate(range(0, len(payload), UNIT)):
        if k % TABLES_EVERY == 0:
            parts.append(_tables(tables & 0x0F))
            tables += 1
        packets = _unit(payload[i : i + UNIT], FIRST_TIME + TICKS * k, counter)
        counter = (counter + len(packets)) & 0x0F
        parts.append(packets.tobytes())
    return b"".join(parts)


@dataclass
class Parsed:
    payload: bytes
    packets: int
    times: list[int]
    random_access: list[int]
    discontinuities: int
    stream_type: int
    table_errors: int


def _section(packet: np.ndarray) -> bytes:
    raw = packet.tobytes()
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    at += 1 + raw[at]
    return raw[at : at + 3 + (struct.unpack_from(">H", raw, at + 1)[0] & 0x0FFF)]


@cache
def _valid(section: bytes) -> bool:
    return _section_crc(section) == 0


def parse(stream: bytes) -> Parsed:
    """Read a transport stream of one programme. Raises ValueError where it is not one."""
    if len(stream) % PACKET or not stream:
        raise ValueError("not whole transport packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    starts = (p[:, 1] & 0x40) != 0
    errors = 0

    def section(of: int, table: int) -> bytes:
        nonlocal errors
        for i in np.flatnonzero((pid == of) & starts):
            found = _section(p[i])
            if found[0] == table and _valid(found):
                return found
            errors += 1
        raise ValueError(f"no table {table} in packets {of}")

    pat = section(PAT_PID, 0x00)
    programmes = [struct.unpack_from(">HH", pat, i) for i in range(8, len(pat) - 4, 4)]
    pmt = section(next(x & 0x1FFF for number, x in programmes if number), 0x02)
    at = 12 + (struct.unpack_from(">H", pmt, 10)[0] & 0x0FFF)
    kind, own = struct.unpack_from(">BH", pmt, at)
    mine = np.flatnonzero(pid == (own & 0x1FFF))
    q = p[mine]
    control = q[:, 3] >> 4 & 3
    field = np.where(control & 2, q[:, 4].astype(np.int64) + 1, 0)
    begin = np.where(control & 1, 4 + field, PACKET)
    counters = (q[:, 3] & 0x0F)[(control & 1) == 1].astype(np.int64)
    broken = int((np.diff(counters) % 16 != 1).sum())
    access = mine[(field > 1) & ((q[:, 5] & 0x40) != 0)] * PACKET
    body = q[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    heads = (ends - (PACKET - begin))[starts[mine]]
    payload, times = [], []
    for i, j in zip(heads, [*heads[1:], len(body)], strict=True):
        if body[i : i + 3] != b"\0\0\x01":
            raise ValueError("no PES start code")
        size, flags, extra = struct.unpack_from(">H", body, i + 4)[0], body[i + 7], body[i + 8]
        if flags & 0x80:
            a, b, c, d, e = body[i + 9 : i + 14]
            times.append((a >> 1 & 7) << 30 | b << 22 | c >> 1 << 15 | d << 7 | e >> 1)
        payload.append(body[i + 9 + extra : i + 6 + size if size else j])
    return Parsed(b"".join(payload), len(p), times, access.tolist(), broken, kind, errors)


def padded(text: bytes, multiple: int = 192) -> bytes:
    """text with spaces up to a positive multiple."""
    return text + b" " * (-len(text) % multiple if text else multiple)


def features(x: Parsed) -> str:
    """A line of what the stream holds: packets, units, times, random access, and the mean sample."""
    mean = sum_of(x.payload) / max(1, len(x.payload))
    return (
        f"packets={x.packets} units={len(x.times)} pts={x.times[0]}..{x.times[-1]} access={len(x.random_access)}"
        f" discontinuities={x.discontinuities} type={x.stream_type} mean={mean:.4f}"
    )


def sum_of(payload: bytes) -> int:
    return int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64))


def _encode(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        rows, size, first = [], 0, 0
        for i, text in enumerate(texts):
            raw = (text.as_py() or "").encode()
            rows.append((len(raw), store(padded(raw))))
            size += len(rows[-1][1])
            if size > most or i == len(texts) - 1:
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)).cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])
                rows, size, first = [], 0, i + 1


def media_column(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text (null: empty) in UTF-8, padded and stored as a transport stream."""
    return in_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _encode, "doc_id long, n_bytes long, media binary")


_PARSED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts_first long, pts_last long, access_points array<long>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PARSED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    for batch in batches:
        rows = []
        for doc_id, n_bytes, media in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "media")), strict=True):
            raw = media.as_py()
            x = parse(raw)
            rows.append((doc_id.as_py(), n_bytes.as_py(), len(x.payload), hashlib.sha256(x.payload).hexdigest(), zlib.crc32(x.payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), features(x), x.times[0], x.times[-1], x.random_access))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def describe_media(media: DataFrame) -> DataFrame:
    """What ``parse`` reads back from each row of (doc_id, n_bytes, media)."""
    return in_arrow(media, _describe, _PARSED)


def media_features(documents: DataFrame) -> DataFrame:
    """Store every text as a transport stream and describe it as read back. Equal texts give equal values; null is empty."""
    return describe_media(media_column(documents))
