"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else as well, in the same document or another.

1. Every window of ``length`` bytes names an anchor in it: the place of the least hash among its runs of ``gram`` bytes.
   Equal windows name equal anchors, so a window can only be repeated where its anchor's hash is. Suffixes are indexed at
   anchors alone, one for each 70 bytes or so. Where a window has its least hash twice (periodic text), no place is the
   anchor: such windows are told by their own digests instead, counted inside their document first.
2. A batch of documents becomes a run: its suffixes in the order of their heads' hashes, a table in the shared folder. It
   is merge-scanned against itself and against each level that exists, which tells the heads they share; runs of equal
   size then merge into one of twice the size, so there are logarithmically many levels and a suffix is written
   logarithmically often. A later batch meets all earlier ones (``SuffixIndex``).
3. What shares its head is cut out as snippets: an anchor with the bytes of all windows that name it. Equal snippets are
   counted where they are cut out; a snippet that occurs twice is repeated as a whole. Different ones are dealt by their
   head, sorted, and taken some thousands at a time, heads kept whole: their suffix arrays (after the anchor, and reversed
   before it) with the common prefixes of neighbours tell which of them share a window, and where.
4. Heads with more than ``most_snippets`` different snippets are split: a snippet is cut into parts whose windows have their
   anchor in one block of offsets, four parts or so, and a part's head is what all windows of its block have in common.
   Equal windows meet under equal heads. Equal parts are counted again, and heads that still hold too many are split on,
   with blocks of a fourth, down to single windows. So a task holds a batch and one head's snippets at most.
5. A snippet's repeated windows always overlap, so each gives one span; spans go back to all places where the snippet
   stands, and each document is cut once.

Null texts are empty; texts shorter than ``length`` have nothing to remove. Repeated rows and copies of ``length`` bytes
or more are removed in full, each of them. Very long and periodic texts take time in proportion to their length. An empty
table gives no rows; columns but doc_id and text are ignored. Offsets are bytes of UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BYTE_VALUES, discard, in_arrow, materialise, prefix_hash, release, row_blocks, row_key, span_hash, utf8

_PLACE = np.uint64((1 << 24) - 1)
_SEGMENT = 1 << 23  # bytes of a text that are looked at at once


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` keys in a row."""
    width = 1
    while 2 * width <= span:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    return np.minimum(keys[: len(keys) - (span - width)], keys[span - width :]) if width < span else keys


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """row, hash, first window, last window, anchor of all anchors in a block of texts, and the starts of windows without one."""
    span, n = length - gram + 1, len(data)
    nothing = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < length:
        return nothing
    at = np.arange(n - gram + 1)
    hashes = span_hash(prefix_hash(BYTE_VALUES[data]), at, at + gram) >> np.uint64(1)
    high, at = hashes >> np.uint64(23) << np.uint64(24), at.astype(np.uint64)
    least = _least(high | at, span)
    # The least hash read from the right: another place means that the window has it twice.
    last = _PLACE - (_least(high | (_PLACE - at), span) & _PLACE)
    inside = np.zeros(n + 1, np.int32)
    ends = offsets[1:] - length + 1
    some = ends > offsets[:-1]
    np.add.at(inside, offsets[:-1][some], 1)
    np.add.at(inside, ends[some], -1)
    starts = np.flatnonzero(np.cumsum(inside[: len(least)]) > 0)
    twice = (least[starts] & _PLACE) != last[starts]
    tied, starts = starts[twice], starts[~twice]
    if not len(starts):
        return (*nothing[:5], tied)
    place = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(starts)) - 1
    row = np.searchsorted(offsets, starts[first], side="right") - 1
    return row, hashes[place[first]].view(np.int64), starts[first], starts[end], place[first], tied


#: Rows of three kinds: an anchor (h, x0, x1, p), a window without one (w, x0, and n of it in its document), and a span
#: (x0 to x1) of windows that their own document repeats.
_MARK = "k long, th long, h long, x0 long, x1 long, p long, w binary, n long"
_MARK_NAMES = [x.split()[0] for x in _MARK.split(", ")]


def _find_anchors(length: int, gram: int):
    def tied_rows(k: int, th: int, text: bytes, starts: list[int]) -> Iterator[tuple]:
        """Windows without an anchor of one document."""
        where: dict[bytes, list[int]] = {}
        for x in starts:
            seen = where.setdefault(xxhash.xxh3_128_digest(text[x : x + length]), [])
            seen.append(x)
        for w, seen in where.items():
            yield k, th, None, seen[0], None, None, w, len(seen)
        again = sorted(x for seen in where.values() if len(seen) > 1 for x in seen)
        a = b = None
        for x in again:
            if b is not None and x <= b:
                b = x + length
                continue
            if b is not None:
                yield k, th, None, a, b, None, None, None
            a, b = x, x + length
        if b is not None:
            yield k, th, None, a, b, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.binary(), pa.int64()]
        for batch in batches:
            data, at = utf8(batch.column("text"))
            k, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "th"))
            for i, j in row_blocks(at):
                tied: dict[int, list[np.ndarray]] = {}
                for start in range(int(at[i]), max(int(at[i]) + 1, int(at[j])), _SEGMENT):
                    # A longer text is looked at piece by piece; windows start in one piece only.
                    stop = min(int(at[j]), start + _SEGMENT + length - 1)
                    own = np.clip(at[i : j + 1], start, stop) - start
                    row, h, x0, x1, p, loose = anchors(data[start:stop], own, length, gram)
                    base = at[i + row] - start
                    found = [pa.array(x) for x in (k[i + row], th[i + row], h, x0 - base, x1 - base, p - base)]
                    yield pa.RecordBatch.from_arrays([*found, *(pa.nulls(len(row), t) for t in types[6:])], names=_MARK_NAMES)
                    of = np.searchsorted(own, loose, side="right") - 1
                    for r in np.unique(of).tolist():
                        tied.setdefault(i + r, []).append(loose[of == r] + start - at[i + r])
                for r, parts in tied.items():
                    rows = list(tied_rows(int(k[r]), int(th[r]), data[at[r] : at[r + 1]].tobytes(), np.concatenate(parts).tolist()))
                    for a in range(0, len(rows), 50_000):
                        columns = zip(*rows[a : a + 50_000], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_MARK_NAMES)

    return run


_SNIPPET = "k long, th long, x0 long, s1 long, s2 long, h long, lead int, n long, snippet binary"


def _cut(length: int, most: int = 16 << 20):
    """Rows of two kinds: a place of a snippet (k, th, x0), and a snippet with its count so far (h, lead, n, snippet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys, rows = np.frombuffer(b"".join(held), ">i8").astype(np.int64).reshape(-1, 2), list(held.values())
            nothing = pa.nulls(len(rows), pa.int64())
            h, lead, n, snippet = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([nothing, nothing, nothing, pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(h, pa.int64()), pa.array(lead, pa.int32()), pa.array(n, pa.int64()), pa.array(snippet, pa.binary())], names=names)

        names = [x.split()[0] for x in _SNIPPET.split(", ")]
        for batch in batches:
            data, at = utf8(batch.column("text"))
            k, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "th"))
            found = batch.column("found")
            parts = {f: found.flatten().field(f).to_numpy() for f in ("h", "x0", "x1", "p")}
            ends = np.cumsum(found.value_lengths().to_numpy())
            for i in range(batch.num_rows):
                text, keys = data[at[i] : at[i + 1]].tobytes(), []
                lo, hi = int(ends[i - 1]) if i else 0, int(ends[i])
                x0 = parts["x0"][lo:hi]
                for h, a, b, p in zip(parts["h"][lo:hi].tolist(), x0.tolist(), parts["x1"][lo:hi].tolist(), parts["p"][lo:hi].tolist(), strict=True):
                    snippet = text[a : b + length]
                    key = xxhash.xxh3_128_digest(snippet)
                    keys.append(key)
                    if key in held:
                        held[key][2] += 1
                    else:
                        held[key] = [h, p - a, 1, snippet]
                        size += len(snippet)
                both = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
                m = len(both)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, k[i])), pa.array(np.full(m, th[i])), pa.array(x0), pa.array(both[:, 0]), pa.array(both[:, 1]), *(pa.nulls(m, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=names
                )
                if size > most:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return run


class Run:
    """Snippets in suffix order: members, their bytes from the anchor on, and reversed before it."""

    def __init__(self, member: np.ndarray, after: np.ndarray, before: np.ndarray, lead: np.ndarray, behind: np.ndarray) -> None:
        order = np.argsort(np.ascontiguousarray(after).view(f"S{after.shape[1]}").ravel(), kind="stable")
        self.member, self.after, self.before = member[order], after[order], before[order]
        self.lead, self.behind = lead[order], behind[order]

    @staticmethod
    def of(member: np.ndarray, snippets: list[bytes], lead: np.ndarray, length: int, gram: int) -> Run:
        after = np.zeros((len(snippets), length), np.uint8)
        before = np.zeros((len(snippets), length - gram), np.uint8)
        for i, (s, at) in enumerate(zip(snippets, lead.tolist(), strict=True)):
            tail = np.frombuffer(s, np.uint8)
            after[i, : len(s) - at] = tail[at:]
            before[i, :at] = tail[:at][::-1]
        return Run(member, after, before, lead, np.array([len(s) for s in snippets]) - lead)

    def __len__(self) -> int:
        return len(self.member)

    @staticmethod
    def _shared(rows: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each row and the one before it; 0 for the first."""
        out = np.zeros(len(rows), np.int64)
        for i in range(1, len(rows), 4096):
            differ = rows[i : i + 4096] != rows[i - 1 : i - 1 + len(rows[i : i + 4096])]
            out[i : i + 4096] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        return out

    def scan(self, hits: np.ndarray, length: int) -> None:
        """Mark in hits[member, offset] the windows, offset bytes before their anchor, that two members share."""
        shared = self._shared(self.after)
        order = np.argsort(np.ascontiguousarray(self.before).view(f"S{self.before.shape[1]}").ravel(), kind="stable")
        before = self._shared(self.before[order])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        least = length - self.behind
        for o in range(int(least.min()), int(self.lead.max()) + 1):
            own = np.flatnonzero((least <= o) & (self.lead >= o))
            if len(own) < 2:
                continue
            right = np.cumsum(shared < length - o)[own]
            left = np.cumsum(before < o)[place][own]
            key = right * (len(self) + 1) + left
            ranked = np.argsort(key, kind="stable")
            same = key[ranked][1:] == key[ranked][:-1]
            twice = np.zeros(len(own), bool)
            twice[1:] |= same
            twice[:-1] |= same
            hits[self.member[own[ranked[twice]]], o] = True


_PART = "p1 long, p2 long, x int, s1 long, s2 long, h long, lead int, n long, snippet binary"


def _split(length: int, gram: int, width: int):
    """Parts (s1, s2, h, lead, n, snippet) of snippets (p1, p2) and where they begin there: the windows whose offset, in bytes before the anchor, is of one block of ``width``."""
    names = [x.split()[0] for x in _PART.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in _PART.split(", ")]

    def parts(s1: int, s2: int, lead: int, n: int, snippet: bytes) -> Iterator[tuple]:
        least = lead - (len(snippet) - length)
        for block in range(least // width * width, lead + 1, width):
            x, end = lead - min(lead, block + width - 1), lead - max(least, block) + length
            head = snippet[lead - block : lead + length - min(block + width - 1, length - gram)]
            key = xxhash.xxh3_128_digest(snippet[x:end])
            h = int.from_bytes(xxhash.xxh3_64_digest(head, block), "big", signed=True)
            yield s1, s2, x, int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True), h, lead - x, n, snippet[x:end]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 10_000):
                columns = (batch.column(c).slice(i, 10_000).to_pylist() for c in ("s1", "s2", "lead", "n", "snippet"))
                rows = [part for row in zip(*columns, strict=True) for part in parts(*row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


_SPAN = "s1 long, s2 long, a int, b int"


def _index(length: int, gram: int, batch_rows: int):
    def repeated(rows: dict[tuple[int, int], list]) -> pa.RecordBatch:
        """The spans of a batch of different snippets (lead, n, bytes) that hold all of their heads'."""
        lead, n = (np.array([r[x] for r in rows.values()]) for x in (0, 1))
        snippets = [r[2] for r in rows.values()]
        hits = np.zeros((len(rows), length - gram + 1), bool)
        Run.of(np.arange(len(rows)), snippets, lead, length, gram).scan(hits, length)
        size = np.array([len(x) for x in snippets])
        a = np.where(n > 1, 0, lead - (hits.shape[1] - 1 - hits[:, ::-1].argmax(1)))
        b = np.where(n > 1, size, lead - hits.argmax(1) + length)
        keep = np.flatnonzero(hits.any(1) | (n > 1))
        keys = np.array(list(rows), np.int64).reshape(-1, 2)[keep]
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(a[keep].astype(np.int32)), pa.array(b[keep].astype(np.int32))], names=["s1", "s2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int], list] = {}
        head = None
        for batch in batches:
            for h, s1, s2, lead, n, snippet in zip(*(batch.column(c).to_pylist() for c in ("h", "s1", "s2", "lead", "n", "snippet")), strict=True):
                if h != head and len(rows) >= batch_rows:
                    yield repeated(rows)
                    rows = {}
                head = h
                if (s1, s2) in rows:
                    rows[s1, s2][1] += n
                else:
                    rows[s1, s2] = [lead, n, snippet]
        if rows:
            yield repeated(rows)

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        found, rows = batch.column("spans"), []
        for i, spans in enumerate(found):
            text = data[at[i] : at[i + 1]]
            n, removed, runs = len(text), 0, 0
            kept = hashlib.sha256()
            if spans.is_valid and len(spans):
                end = 0
                for s in sorted((x["a"], x["b"]) for x in spans.as_py()):
                    if s[0] > end or not runs:
                        kept.update(text[end : s[0]].tobytes())
                        runs, removed, end = runs + 1, removed + s[1] - s[0], s[1]
                    elif s[1] > end:
                        removed, end = removed + s[1] - end, s[1]
                kept.update(text[end:].tobytes())
            else:
                kept.update(text.tobytes())
            rows.append((n, removed, runs, kept.hexdigest()))
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


class SuffixIndex:
    """The family of runs over the batches appended so far, as tables in the shared folder.

    texts: a frame (k, th, text) in which the texts of all appended documents are found; the index keeps places, not texts.
    """

    def __init__(self, texts: DataFrame, length: int = 200, gram: int = 64, batch_rows: int = 8192, most_snippets: int = 2048) -> None:
        self.texts, self.length, self.gram, self.batch_rows, self.most_snippets = texts, length, gram, batch_rows, most_snippets
        self.levels: list[DataFrame | None] = []  # level i holds 2**i batches

    def append(self, documents: DataFrame) -> DataFrame:
        """Add a batch (k, th, text); k, th, a, b: what it makes repeated, in its own documents and in earlier ones. Spans may overlap."""
        run = materialise(in_arrow(documents, _find_anchors(self.length, self.gram), _MARK).sortWithinPartitions("h"), "run")
        levels = [x for x in self.levels if x is not None]
        places = run
        for level in levels:
            places = places.union(level)
        heads = run.where("h is not null").groupBy("h").agg(F.count("*").alias("c"))
        windows = run.where("w is not null").groupBy("w").agg(F.sum("n").alias("c"))
        for level in levels:  # the merge scan: what the run and a level have in common
            heads = heads.join(level.where("h is not null").groupBy("h").agg(F.count("*").alias("d")), "h", "left")
            heads = heads.select("h", (F.col("c") + F.coalesce("d", F.lit(0))).alias("c"))
            windows = windows.join(level.where("w is not null").groupBy("w").agg(F.sum("n").alias("d")), "w", "left")
            windows = windows.select("w", (F.col("c") + F.coalesce("d", F.lit(0))).alias("c"))
        # Written first: a join of two exchanges can be split where one hash has very many places.
        heads = materialise(heads.where("c > 1").select("h"), "heads")
        loose = places.where("w is not null and n = 1").join(windows.where("c > 1"), "w", "left_semi").select("k", "th", F.col("x0").alias("a"), (F.col("x0") + self.length).alias("b"))
        own = run.where("h is null and w is null").select("k", "th", F.col("x0").alias("a"), F.col("x1").alias("b"))
        loose = materialise(loose.union(own), "loose")
        found = places.where("h is not null").join(heads, "h").groupBy("k", "th").agg(F.collect_set(F.struct("h", "x0", "x1", "p")).alias("found"))  # of one document
        found = materialise(found, "found")
        discard(heads)
        self._enter(run)
        del run, levels, places, heads
        release(documents.sparkSession)
        spans = self._snippet_spans(found)
        out = materialise(spans.union(loose), "placed")
        discard(found, loose, *self._scrap)
        release(documents.sparkSession)
        return out

    def _enter(self, run: DataFrame) -> None:
        """Make the run a level; levels of equal size merge into one of twice the size."""
        for i in range(len(self.levels)):
            old, self.levels[i] = self.levels[i], None
            if old is None:
                self.levels[i] = run
                return
            merged = materialise(run.union(old).repartition("h", "k").sortWithinPartitions("h"), "run")
            discard(run, old)
            run = merged
        self.levels.append(run)

    def _snippet_spans(self, found: DataFrame) -> DataFrame:
        """k, th, a, b from the anchors (found: h, x0, x1, p) of each document that share their heads with others."""
        length = self.length
        cut = materialise(in_arrow(self.texts.join(found, ["k", "th"]).select("k", "th", "text", "found"), _cut(length), _SNIPPET), "snippets")
        self._scrap = [cut]
        width = 1
        while 4 * width < length - self.gram + 1:
            width *= 4
        spans = materialise(self._repeats(cut.where("snippet is not null").select("s1", "s2", "h", "lead", "n", "snippet"), width), "spans")
        self._scrap.append(spans)
        places = cut.where("snippet is null").select("k", "th", "x0", "s1", "s2").join(spans, ["s1", "s2"])
        return places.select("k", "th", (F.col("x0") + F.col("a")).alias("a"), (F.col("x0") + F.col("b")).alias("b"))

    def _repeats(self, snippets: DataFrame, width: int) -> DataFrame:
        """s1, s2, a, b: the span of repeated windows of each snippet that has some; heads with too many snippets are split by blocks of ``width`` offsets."""
        keep = lambda rows: rows.groupBy("s1", "s2").agg(*(F.first(c).alias(c) for c in ("h", "lead", "snippet")), F.sum("n").alias("n"))
        deal = lambda rows: in_arrow(rows.repartition("h").sortWithinPartitions("h"), _index(self.length, self.gram, self.batch_rows), _SPAN)
        if not width:  # single windows
            return deal(snippets)
        hot = materialise(snippets.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > self.most_snippets).select("h"), "hot")
        self._scrap.append(hot)
        if hot.isEmpty():
            return deal(snippets)
        spans = deal(snippets.join(hot, "h", "left_anti"))
        parts = materialise(in_arrow(keep(snippets.join(hot, "h", "left_semi")), _split(self.length, self.gram, width), _PART), "parts")
        own = materialise(keep(parts).select("s1", "s2", "h", "lead", "n", "snippet"), "own")
        self._scrap += [parts, own]
        inner = parts.select("p1", "p2", "x", "s1", "s2").join(self._repeats(own, width // 4), ["s1", "s2"])
        inner = inner.groupBy(F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.min(F.col("a") + F.col("x")).alias("a"), F.max(F.col("b") + F.col("x")).alias("b"))
        return spans.union(inner)

    def close(self) -> None:
        """Delete the levels."""
        discard(*(x for x in self.levels if x is not None))
        self.levels = []


def repeated_spans(documents: DataFrame, length: int = 200, gram: int = 64, batches: int = 2, **limits: int) -> DataFrame:
    """k, th, spans: byte spans (a, b) to remove of each document that has some, by its ``row_key``; spans may overlap.

    batches: the documents are appended in so many batches, by a hash. Equal rows are of one batch.
    """
    docs = documents.select(*row_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    index = SuffixIndex(docs, length, gram, **limits)
    batch = F.pmod(F.xxhash64("k", "th"), F.lit(batches))
    found = [index.append(docs.where(batch == i)) for i in range(batches)]
    index.close()
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    out = materialise(spans.groupBy("k", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")  # of one document
    discard(*found)
    return out


def remove_repeats(documents: DataFrame, length: int = 200, gram: int = 64, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of (doc_id, text). See ``repeated_spans`` and ``SuffixIndex`` for limits."""
    spans = repeated_spans(documents, length, gram, **limits)
    release(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", *row_key(), "text")
    out = docs.join(spans, ["k", "th"], "left").select("doc_id", "text", "spans")
    return in_arrow(out, _apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
