"""Token ids of documents as flat binary files with 64-bit offsets.

Layout below one folder, a set of files for each shard (a range of ascending document ids):

* ``shard-<n>.bin``: all token ids in order, unsigned little-endian, 16 bits each if the vocabulary allows it, else 32;
* ``shard-<n>.off``: one unsigned 64-bit number more than the shard has documents, the token offsets of the documents
  within the shard;
* ``shard-<n>.ids``: the documents' ids as signed 64-bit integers (the least integer stands for null).

Shards are written by the executors that hold them, each file under a name of the attempt first and renamed when it is
whole, so a task that runs twice leaves the same files. What comes back to the driver is one small row for each shard;
prefix sums over these rows give each shard's base, which makes local offsets global. Readers map the files into memory
(where the folder is not a mounted one, pyarrow's file systems read them).

Null and empty texts become the end id alone. Rows of equal ids are ordered by a hash of their text; rows equal in
both are exact repeats. Null ids come first.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from typing import Any
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, row_blocks, scratch_path, utf8

_NULL_ID = -(2**63)
#: White space that stands in the way of cutting a text before each single space and line feed: such texts are encoded whole.
_ODD_SPACE = "[ \n][ \n]| $|[\t\x0b\x0c\r\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A line feed or none, Latin or Cyrillic letters, and signs after them: the pre-tokeniser parts letters and signs just there.
_PLAIN_WORD = r"^(?P<word>\n?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"
#: The pre-tokeniser under which a text can be cut before each single space that stands between two other characters.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] for each i of ``which``, one after another."""
    out = []
    for k in range(0, len(which), step):
        own = which[k : k + step]
        n = sizes[own]
        ends = np.cumsum(n)
        out.append(flat[np.repeat(starts[own] - (ends - n), n) + np.arange(ends[-1])])
    return np.concatenate(out) if out else flat[:0]


class Pieces:
    """Ids of the pieces met so far, in flat arrays; forgotten as a whole beyond ``most_bytes``."""

    def __init__(self, dtype: np.dtype, most_bytes: int) -> None:
        self.most_bytes = most_bytes
        self.none = np.zeros(0, dtype)
        self.clear()

    def clear(self) -> None:
        self.names = pa.array([], pa.large_string())
        self.flat, self.starts, self.sizes = self.none, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, names: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.names = pa.concat_arrays([self.names, names])
        self.flat, self.starts, self.sizes = (np.concatenate(x) for x in ((self.flat, flat), (self.starts, starts), (self.sizes, sizes)))

    def find(self, names: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The number of each of ``names``; new ones are learned together: (their ids, how many each has)."""
        if self.names.nbytes + self.flat.nbytes + self.starts.nbytes * 2 > self.most_bytes:
            self.clear()
        at = pc.index_in(names, self.names)
        out = at.fill_null(-1).to_numpy().astype(np.int64)
        if at.null_count:
            new = names.filter(at.is_null()).dictionary_encode()
            out[out < 0] = len(self.names) + new.indices.to_numpy()
            self.add(new.dictionary, *learn(new.dictionary))
        return out


class Encoder:
    """Encodes texts by a file of the tokenizers library, each distinct word of a batch once.

    Under a byte-level pre-tokeniser no token spans a single space or line feed and what stands before it, so a text's
    ids are those of its words one after another; a plain word's are those of its letters and of the signs after them.
    A batch's words are numbered by Arrow, and the ids of its texts gathered from those of its distinct words. Pieces not
    met before are encoded together, a line feed between them, which is a token of its own. Other tokenisers, texts with
    odd white space and texts with added tokens are encoded whole.
    """

    def __init__(self, path: str, end_id: int, most_bytes: int = 48 << 20) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.feed = self.tokenizer.token_to_id("\u010a")
        self.by_words = spec.get("normalizer") is None and self.feed is not None and all(before.get(k) == v for k, v in _BYTE_LEVEL.items())
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end_id = end_id
        # Byte-level models show each byte as a printable character: bytes that are none follow from U+0100 on.
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.shown = np.arange(256, dtype="<u2")
        self.shown[[b for b in range(256) if b not in printable]] = 0x100 + np.arange(256 - len(printable))
        if self.by_words:
            # The same model over pieces that are cut already: parted where a shown line feed stands.
            self.pieces_only = Tokenizer(self.tokenizer.model)
            self.pieces_only.pre_tokenizer = pre_tokenizers.Split(chr(int(self.shown[0x0A])), "isolated")
        self.known = Pieces(self.dtype, most_bytes)
        self.signs = Pieces(self.dtype, most_bytes)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _parted(self, tokenizer: Any, pieces: list[str], shown: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and how many each has. A piece is not empty and holds no line feed."""
        flat, sizes = [], []
        for i in range(0, len(pieces), 8192):
            part = pieces[i : i + 8192]
            text = "\n".join(part)
            if shown:
                text = self.shown[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            feeds = ids == self.feed
            if int(feeds.sum()) != len(part) - 1:
                raise ValueError("the tokeniser does not part words at line feeds")
            cuts = np.flatnonzero(feeds)
            sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            flat.append(ids[~feeds])
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn_signs(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = new.to_pylist()
        if pieces == [""]:
            return self.signs.none, np.zeros(1, np.int64)
        flat, sizes = self._parted(self.pieces_only, [p for p in pieces if p], True)
        return flat, np.insert(sizes, pieces.index(""), 0) if "" in pieces else sizes

    def _learn_words(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words as they stand after a space, or, where they begin with a line feed, with it."""
        words = new.to_pylist()
        fed = np.array([w[0] == "\n" for w in words])
        plain = pc.match_substring_regex(new, _PLAIN_WORD).to_numpy(zero_copy_only=False)
        bare = np.array([w == "\n" for w in words])
        flat = np.full(1, self.feed, self.dtype)
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for tokenizer, own in ((self.pieces_only, plain), (self.tokenizer, ~plain & ~bare)):
            for lead, of in ((" ", np.flatnonzero(own & ~fed)), ("", np.flatnonzero(own & fed))):
                if len(of):
                    ids, n = self._parted(tokenizer, [lead + words[i].removeprefix("\n") for i in of], tokenizer is self.pieces_only)
                    starts[of], sizes[of] = len(flat) + np.cumsum(n) - n, n
                    flat = np.concatenate([flat, ids])
        # Two parts of each word: the line feed or nothing, and the rest.
        parts = np.stack([np.zeros(len(words), np.int64), starts], 1).ravel(), np.stack([fed.astype(np.int64), sizes], 1).ravel()
        return _ragged(flat, *parts, np.arange(2 * len(words))), sizes + fed

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a batch of texts (null counts as empty), each with the end id last, and how many each text has."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_words:
            return self._joined([self._whole(t) if t else self.known.none for t in texts.to_pylist()])
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        ids, sizes = self._by_words(pc.if_else(odd, "", texts) if pc.any(odd).as_py() else texts)
        if not pc.any(odd).as_py():
            return ids, sizes
        ends = np.cumsum(sizes)
        rows = [ids[e - n : e - 1] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            rows[i] = self._whole(texts[i].as_py())
        return self._joined(rows)

    def _joined(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        end = np.full(1, self.end_id, self.dtype)
        flat = [x for r in rows for x in (r, end)]
        return (np.concatenate(flat) if flat else end[:0]), np.array([len(r) + 1 for r in rows], np.int64)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # Words begin after each space and with each line feed; one that is put before a text marks its first word.
        feed, nothing = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        cut = pc.split_pattern(pc.binary_join_element_wise(feed, pc.replace_substring(texts, "\n", " \n"), nothing), " ")
        numbered = pc.dictionary_encode(cut.flatten())
        words, first = numbered.dictionary, cut.offsets.to_numpy()
        found = pc.extract_regex(words, _PLAIN_WORD)
        word = pc.coalesce(pc.struct_field(found, "word").cast(pa.large_string()), words)
        signs = pc.fill_null(pc.struct_field(found, "signs").cast(pa.large_string()), "")
        w, s = self.known.find(word, self._learn_words), self.signs.find(signs, self._learn_signs)
        # Each distinct word is two pieces, then each place in a text one word.
        base = len(self.known.flat)
        both = np.concatenate([self.known.flat, self.signs.flat])
        starts = np.stack([self.known.starts[w], base + self.signs.starts[s]], 1).ravel()
        sizes = np.stack([self.known.sizes[w], self.signs.sizes[s]], 1)
        flat, sizes = _ragged(both, starts, sizes.ravel(), np.arange(2 * len(w))), sizes.sum(1)
        which = numbered.indices.to_numpy()
        ids = _ragged(flat, np.cumsum(sizes) - sizes, sizes, which)
        upto = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes[which], out=upto[1:])
        rows = upto[first - first[0]]
        # The line feed before a text stands where the text before it needs its end id.
        ids[rows[:-1]] = self.end_id
        return np.append(ids[1:], np.array([self.end_id], self.dtype)) if len(ids) else ids, np.diff(rows)


@cache
def _encoder(path: str, end_id: int) -> Encoder:
    """The worker's encoder: tasks that follow one another in a worker share the pieces it knows."""
    return Encoder(path, end_id)


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _write_shard(folder: str, tokenizer: str, end_id: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        place, fs = _local(folder), None
        if place is None:
            from pyarrow import fs as stores

            fs, place = stores.FileSystem.from_uri(folder)
        encoder, offsets, ids = None, [np.zeros(1, np.uint64)], []
        total, name = 0, f"{place}/shard-{shard:06d}"
        part = f"{place}/.attempt-{attempt}-{shard:06d}"
        out = None
        for batch in batches:
            keys = batch.column("doc_id").cast(pa.int64()).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            column = batch.column("text")
            _, at = utf8(column)
            for i, j in row_blocks(at, batch_bytes):
                encoder = encoder or _encoder(tokenizer, end_id)
                if out is None:
                    if fs is None:
                        os.makedirs(place, exist_ok=True)
                    out = open(part + ".bin", "wb") if fs is None else fs.open_output_stream(part + ".bin")  # noqa: SIM115
                flat, sizes = encoder.encode(column.slice(i, j - i))
                out.write(flat.tobytes())
                ends = total + np.cumsum(sizes).astype(np.uint64)
                total = int(ends[-1])
                offsets.append(ends)
                ids.append(keys[i:j])
        if out is None:
            return
        out.close()
        for suffix, content in ((".off", np.concatenate(offsets).astype("<u8")), (".ids", np.concatenate(ids).astype("<i8"))):
            with open(part + suffix, "wb") if fs is None else fs.open_output_stream(part + suffix) as f:
                f.write(content.tobytes())
        for suffix in (".bin", ".off", ".ids"):
            (os.replace if fs is None else fs.move)(part + suffix, name + suffix)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "docs": sum(map(len, ids)), "tokens": total, "width": encoder.dtype.itemsize}])

    return run


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 0, batch_bytes: int = 8 << 20, order: tuple[str, ...] = ()) -> list[dict]:
    """Write (doc_id, text) as token files below ``folder``; a list with a dict (shard, docs, tokens, width, base) for each shard.

    folder: a URI or path that all executors and readers share. The list is as long as there are shards. order: columns by
    which the documents are ordered, if not by their ids.
    """
    docs = documents.select(*order, F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t")).withColumn("th", F.xxhash64("t"))
    by = [*order, "id", "th"]
    ordered = docs.repartitionByRange(*by).sortWithinPartitions(*by).select(F.col("id").alias("doc_id"), F.col("t").alias("text"))
    rows = in_arrow(ordered, _write_shard(folder, tokenizer, end_id, batch_bytes), "shard long, docs long, tokens long, width long").collect()
    manifest, base = [], 0
    for row in sorted(rows, key=lambda r: r.shard):
        manifest.append(row.asDict() | {"base": base})
        base += row.tokens
    return manifest


def _load(folder: str, name: str, dtype: str) -> np.ndarray:
    place = _local(folder)
    if place is not None:
        return np.memmap(f"{place}/{name}", dtype=dtype, mode="r")
    from pyarrow import fs as stores

    fs, place = stores.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{place}/{name}") as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def read_shard(folder: str, shard: int, width: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, local start, token ids) of a shard's documents in order, from its mapped files."""
    tokens = _load(folder, f"shard-{shard:06d}.bin", f"<u{width}")
    offsets = _load(folder, f"shard-{shard:06d}.off", "<u8")
    for i, key in enumerate(_load(folder, f"shard-{shard:06d}.ids", "<i8")):
        a, b = int(offsets[i]), int(offsets[i + 1])
        yield None if key == _NULL_ID else int(key), a, tokens[a:b]


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for key, start, ids in read_shard(folder, row["shard"], row["width"]):
                    out.append((key, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 20_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


_INDEX = "doc_id long, start long, n_tokens long, ids_crc32 long"


def token_index(documents: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, as read back from the token files it writes.

    start: token ids of all documents before it. folder: where the files stay; a scratch folder by default. order: columns
    that the documents are ordered by, if not by their ids.
    An empty table makes no file and gives no rows.
    """
    spark = documents.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    manifest = write_token_files(documents, folder, tokenizer, end_id, order=order)
    shards = spark.createDataFrame([(m["shard"], m["width"], m["base"]) for m in manifest], "shard long, width long, base long")
    return in_arrow(shards.repartition(max(1, len(manifest))), _read(folder), _INDEX)
