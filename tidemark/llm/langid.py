"""Language identification by interpolated Kneser-Ney models of four characters.

Texts are read as lower-case letters; whatever is no letter becomes a space and spaces in a row one space. Each language
has its own model, kept in sorted arrays of packed 64-bit keys (four symbols of 16 bits): discounted probabilities for
n-grams of 1 to 4 symbols and back-off weights for their contexts. The prediction is the language of lowest cross-entropy
a symbol; its score is the softmax of all cross-entropies at a fitted temperature; a prediction is accepted if the
cross-entropy is no higher than what held-back labelled texts reach, with room to spare.

n-gram counts cover every training row. They are summed in the workers and by a shuffle on (lang, gram). Up to
``most_grams`` distinct n-grams of four letters in all languages are made a model on the driver and broadcast. Where there
are more, none is dropped: the same discounts, continuation counts and probabilities are made by shuffles, written to the
shared folder as sorted arrays, and mapped into memory by the workers. Calibration reads every row of its fold too: workers
sum the loss at each temperature, as whole numbers, and keep each language's highest cross-entropy. Where no fold is to be
held out, ``cross_train_languages`` counts and calibrates every row: models of each half are measured on the other one, and
the models that predict are made of the counts of both.

Null texts, empty texts and texts without letters are ``und`` with score 0 and not accepted; so is every text if there is
no labelled row to learn from. Repeated rows are counted as often as they occur and predicted alike; of languages of equal
entropy the first by code point is predicted. Very long texts are read in full, a block of n-grams at a time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_arrow, materialise, row_blocks, scratch_path, utf8
from tidemark.llm.token_files import _local as local_path

_SPACE, _OTHER = 0x20, 0xFFFF
_LOW48 = np.uint64((1 << 48) - 1)
_SHIFT = np.uint64(16)
#: Bytes of text that a worker looks at at once, and n-grams that it holds before it sums or gives them up.
_BLOCK, _MOST_HELD = 1 << 18, 1 << 20
#: Temperatures that calibration tries, and the parts of a nat in which it sums losses: whole numbers add up alike in any order.
_TEMPERATURES, _PARTS = 2.0 ** np.arange(-2, 9), 1 << 20


@cache
def _symbols() -> np.ndarray:
    """Symbol of each code point of the basic plane: its lower case if it is a letter, else a space."""
    table = np.full(1 << 16, _SPACE, np.uint16)
    for c in range(1 << 16):
        if chr(c).isalpha():
            table[c] = min(ord(chr(c).lower()[0]), _OTHER)
    return table


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4-grams of all rows one after another, the n + 1 offsets of the rows among them, and each row's letters."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    at = first[offsets]
    symbols = _symbols()[np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    if len(beyond):
        symbols[beyond] = [_OTHER if chr(c).isalpha() else _SPACE for c in points[beyond]]
    space = symbols == _SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    begins = at[:-1][at[:-1] < len(keep)]
    keep[begins] = True
    kept = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    letters = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(~space, out=letters[1:])
    rows, n = len(offsets) - 1, int(kept[-1])
    ends = kept[at]
    padded = np.full(n + 3 * rows, _SPACE, np.uint64)
    place = np.arange(n) + 3 * (np.repeat(np.arange(rows), np.diff(ends)) + 1)
    padded[place] = symbols[keep]
    packed = padded[place]
    for back in (1, 2, 3):
        packed |= padded[place - back] << np.uint64(16 * back)
    return packed, ends, np.diff(letters[at])


class KneserNey:
    """One language's model; built from sorted distinct 4-grams and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        levels = [(keys, counts.astype(np.float64))]
        for order in (3, 2, 1):
            suffix = levels[-1][0] & np.uint64((1 << (16 * order)) - 1)
            levels.append(tuple(x.astype(t) for x, t in zip(np.unique(suffix, return_counts=True), (np.uint64, np.float64), strict=True)))
        self.keys: dict[int, np.ndarray] = {}
        self.p: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.back: dict[int, np.ndarray] = {}
        self.uniform = 1.0 / (len(levels[-1][0]) + 1)
        for order in (1, 2, 3, 4):
            keys, counts = levels[4 - order]
            once, twice = float((counts == 1).sum()), float((counts == 2).sum())
            discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
            contexts, place, types = np.unique(keys >> _SHIFT, return_inverse=True, return_counts=True)
            total = np.bincount(place, counts)
            back = discount * types / total
            lower = np.full(len(keys), self.uniform) if order == 1 else self.prob(order - 1, keys & np.uint64((1 << (16 * (order - 1))) - 1))
            self.keys[order], self.contexts[order], self.back[order] = keys, contexts, back
            self.p[order] = np.maximum(counts - discount, 0) / total[place] + back[place] * lower

    def prob(self, order: int, grams: np.ndarray) -> np.ndarray:
        """P(last symbol | the others) of packed n-grams of this order, seen or not."""
        if order == 0:
            return np.full(len(grams), self.uniform)
        seen, out = self._find("p", order, grams)
        if not seen.all():
            rest = grams[~seen]
            lower = self.prob(order - 1, rest & np.uint64((1 << (16 * (order - 1))) - 1))
            known, back = self._find("back", order, rest >> _SHIFT)
            out[~seen] = lower * np.where(known, back, 1.0)
        return out

    def _find(self, kind: str, order: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams (p) or contexts (back) the model has, and their values (0 elsewhere)."""
        keys, values = (self.keys[order], self.p[order]) if kind == "p" else (self.contexts[order], self.back[order])
        return _look_up(keys, values, wanted)


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    seen = keys[at] == wanted
    return seen, np.where(seen, values[at], 0.0)


class MappedKneserNey(KneserNey):
    """One language's model as sorted arrays in the shared folder, in pieces of ascending keys: (kind, order) -> (least keys, files, rows)."""

    def __init__(self, uniform: float, pieces: dict[tuple[str, int], tuple[np.ndarray, list[str], list[int]]]) -> None:
        self.uniform = uniform
        self.pieces = pieces

    def _find(self, kind: str, order: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least, files, rows = self.pieces[kind, order]
        seen, out = np.zeros(len(wanted), bool), np.zeros(len(wanted))
        piece = np.searchsorted(least, wanted, side="right") - 1
        for i in np.unique(piece[piece >= 0]):
            of = np.flatnonzero(piece == i)
            seen[of], out[of] = _look_up(*_mapped(files[i], rows[i]), wanted[of])
        return seen, out


def _mapped(file: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a piece; read as a whole where the shared folder is not a mounted one."""
    place = local_path(file)
    if place is None:
        from pyarrow import fs as stores

        fs, place = stores.FileSystem.from_uri(file)
        with fs.open_input_file(place) as f:
            data = np.frombuffer(f.read(), np.uint64)
    else:
        data = np.memmap(place, np.uint64, "r")
    return data[:rows], data[rows:].view(np.float64)


_PIECE = "lang string, least long, file string, rows long"


def _write_pieces(folder: str):
    """Sorted rows (lang, key, value) become a file for each language; files of tasks that run twice have other names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            langs, key, value = np.array(batch.column("lang").to_pylist(), object), *(batch.column(c).to_numpy() for c in ("key", "value"))
            for lang in set(langs):
                held.setdefault(lang, []).append((key[langs == lang], value[langs == lang]))
        for lang, parts in held.items():
            keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            file, place, fs = f"{folder}/{uuid.uuid4().hex}", local_path(folder), None
            if place is None:
                from pyarrow import fs as stores

                fs, place = stores.FileSystem.from_uri(folder)
            else:
                os.makedirs(place, exist_ok=True)
            name = f"{place}/{file.rpartition('/')[2]}"
            with open(name, "wb") if fs is None else fs.open_output_stream(name) as f:
                f.write(keys.tobytes() + values.tobytes())
            yield pa.RecordBatch.from_pylist([{"lang": lang, "least": int(keys[0]), "file": file, "rows": len(keys)}], pa.schema([("lang", pa.string()), ("least", pa.int64()), ("file", pa.string()), ("rows", pa.int64())]))

    return run


def _mapped_models(counts: DataFrame, piece_rows: int = 1_000_000) -> dict[str, MappedKneserNey]:
    """What ``KneserNey`` makes of (lang, gram, n), by shuffles: as many rows as there are pieces and languages reach the driver."""
    spark = counts.sparkSession
    folder = scratch_path(spark, "languages")
    low = lambda order: F.col("gram").bitwiseAND(F.lit((1 << (16 * order)) - 1))
    levels = {4: counts}
    for order in (3, 2, 1):
        levels[order] = materialise(levels[order + 1].groupBy("lang", low(order).alias("gram")).agg(F.count("*").alias("n")), "grams")
    uniform = {r.lang: 1.0 / (r.n + 1) for r in levels[1].groupBy("lang").agg(F.count("*").alias("n")).collect()}
    pieces: dict[str, dict] = {lang: {} for lang in uniform}

    def write(kind: str, order: int, rows: DataFrame, size: int) -> None:
        unsigned = F.col("key").bitwiseXOR(F.lit(-(2**63)))
        ordered = rows.withColumn("u", unsigned).repartitionByRange(max(1, -(-size // piece_rows)), "lang", "u").sortWithinPartitions("lang", "u")
        found: dict[str, list] = {}
        for r in in_arrow(ordered.select("lang", "key", "value"), _write_pieces(folder), _PIECE).collect():
            found.setdefault(r.lang, []).append((r.least % (1 << 64), r.file, r.rows))
        for lang, own in found.items():
            least, files, n = zip(*sorted(own), strict=True)
            pieces[lang][kind, order] = np.array(least, np.uint64), list(files), list(n)

    lower = None
    for order in (1, 2, 3, 4):
        level = levels[order].withColumn("context", F.shiftrightunsigned("gram", 16))
        few = level.groupBy("lang").agg(F.count_if(F.col("n") == 1).cast("double").alias("once"), F.count_if(F.col("n") == 2).cast("double").alias("twice"), F.count("*").alias("size")).collect()
        discount = [(r.lang, min(0.95, max(0.05, r.once / (r.once + 2 * r.twice))) if r.once else 0.5, uniform[r.lang]) for r in few]
        discount = F.broadcast(spark.createDataFrame(discount, "lang string, discount double, uniform double"))  # a row for each language
        contexts = level.groupBy("lang", "context").agg(F.sum("n").cast("double").alias("total"), F.count("*").alias("types")).join(discount, "lang")
        contexts = materialise(contexts.withColumn("back", F.col("discount") * F.col("types") / F.col("total")), "contexts")
        size = sum(r.size for r in few)
        write("back", order, contexts.select("lang", F.col("context").alias("key"), F.col("back").alias("value")), size)
        rows = level.join(contexts, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("lower", F.col("uniform"))
        else:
            rows = rows.withColumn("suffix", low(order - 1)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
        p = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("lower")
        lower = materialise(rows.select("lang", "gram", p.alias("p")), "level")
        write("p", order, lower.select("lang", F.col("gram").alias("key"), F.col("p").alias("value")), size)
    return {lang: MappedKneserNey(uniform[lang], own) for lang, own in pieces.items()}


class LanguageModels:
    """All languages' models, and a table of the log-probability of each seen 4-gram in every language (none for mapped models)."""

    def __init__(self, models: dict[str, KneserNey]) -> None:
        self.langs = sorted(models)
        self.models = [models[x] for x in self.langs]
        self.temperature = 1.0
        self.most_entropy = np.full(len(self.langs), np.inf)
        mapped = any(isinstance(m, MappedKneserNey) for m in self.models)
        self.keys = np.unique(np.concatenate([m.keys[4] for m in self.models])) if models and not mapped else np.zeros(0, np.uint64)
        self.logs = self._logs(self.keys)

    def _logs(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([np.log(m.prob(4, keys)) for m in self.models], 1).astype(np.float32) if self.models else np.zeros((len(keys), 0), np.float32)

    def entropies(self, packed: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cross-entropy a symbol (nats) of each row in each language; infinite for rows without symbols."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, packed), len(self.keys) - 1)
            logs = self.logs[at]
            missed = np.flatnonzero(self.keys[at] != packed)
        else:  # mapped models
            logs, missed = np.zeros((len(packed), len(self.langs)), np.float32), np.arange(len(packed))
        if len(missed):
            new, place = np.unique(packed[missed], return_inverse=True)
            logs[missed] = self._logs(new)[place]
        n = np.diff(ends)
        out = np.full((len(n), len(self.langs)), np.inf)
        some = n > 0
        if some.any():
            out[some] = -np.add.reduceat(logs.astype(np.float64), ends[:-1][some], axis=0) / n[some, None]
        return out

    def scores(self, entropies: np.ndarray, temperature: float | None = None) -> np.ndarray:
        x = -(self.temperature if temperature is None else temperature) * (entropies - entropies.min(1, keepdims=True))
        e = np.exp(x)
        return e / e.sum(1, keepdims=True)

    def losses(self, entropies: np.ndarray, truth: np.ndarray) -> np.ndarray:
        """The summed loss of rows of known language at each of the temperatures, in parts of a nat."""
        own = (self.scores(entropies, t)[np.arange(len(truth)), truth] for t in _TEMPERATURES)
        return np.array([np.rint(-np.log(np.maximum(x, 1e-12)) * _PARTS).astype(np.int64).sum() for x in own])

    def calibrate(self, losses: np.ndarray, highest: dict[str, float], spare: float) -> None:
        """Take the temperature of least loss, and the highest entropy accepted in each language from the highest seen."""
        self.temperature = float(_TEMPERATURES[losses.argmin()])
        for k, (lang, model) in enumerate(zip(self.langs, self.models, strict=True)):
            if lang in highest:
                top = highest[lang]
                self.most_entropy[k] = top + spare * max(0.0, -np.log(model.uniform) - top)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64)
            for i in range(0, len(keys), 50_000):
                k = keys[i : i + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n[i : i + 50_000])], names=["lang", "gram", "n"])

    for batch in batches:
        data, at = utf8(batch.column("text"))
        langs = batch.column("lang").dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        for i, j in row_blocks(at, _BLOCK):
            packed, ends, _ = grams(data[at[i] : at[j]], at[i : j + 1] - at[i])
            of = np.repeat(codes[i:j], np.diff(ends))
            for c in np.unique(codes[i:j]).tolist():
                held.setdefault(names[c], []).append(np.unique(packed[of == c], return_counts=True))
                size += len(held[names[c]][-1][0])
            if size > _MOST_HELD:
                for lang, parts in held.items():
                    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                    held[lang] = [(keys, np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.int64))]
                size = sum(len(p[0][0]) for p in held.values())
                if size > _MOST_HELD // 2:
                    yield from flush()
                    held, size = {}, 0
    yield from flush()


def _block_bytes(models: LanguageModels) -> int:
    return max(1 << 14, _BLOCK * 4 // max(4, len(models.langs)))


_LOSS = "lang string, highest double, t int, loss long"


def _calibration(shared):
    """Of rows (lang, text): the highest entropy of each language (lang, highest), and the loss at each temperature (t, loss)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: LanguageModels = shared.value
        index = {lang: k for k, lang in enumerate(models.langs)}
        highest, losses = np.full(len(index), -np.inf), np.zeros(len(_TEMPERATURES), np.int64)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            truth = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for i, j in row_blocks(at, _block_bytes(models)):
                packed, ends, letters = grams(data[at[i] : at[j]], at[i : j + 1] - at[i])
                some = np.flatnonzero(letters > 0)
                if len(some):
                    h, own = models.entropies(packed, ends)[some], truth[i:j][some]
                    losses += models.losses(h, own)
                    np.maximum.at(highest, own, h[np.arange(len(own)), own])
        seen = np.flatnonzero(highest > -np.inf)
        if len(seen):
            k, t = len(seen), len(losses)
            columns = [[models.langs[x] for x in seen] + [None] * t, highest[seen].tolist() + [None] * t, [None] * k + list(range(t)), [None] * k + losses.tolist()]
            types = (pa.string(), pa.float64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names=["lang", "highest", "t", "loss"])

    return run


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: LanguageModels = shared.value
        block = _block_bytes(models)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in row_blocks(at, block):
                packed, ends, letters = grams(data[at[i] : at[j]], at[i : j + 1] - at[i])
                n = j - i
                langs, scores, accepted, lowest = ["und"] * n, np.zeros(n), np.zeros(n, bool), np.full(n, np.nan)
                some = np.flatnonzero(letters > 0) if models.langs else []
                if len(some):
                    h = models.entropies(packed, ends)
                    best = h[some].argmin(1)
                    lowest[some] = h[some, best]
                    scores[some] = models.scores(h[some])[np.arange(len(some)), best]
                    accepted[some] = lowest[some] <= models.most_entropy[best]
                    for r, b in zip(some, best, strict=True):
                        langs[r] = models.langs[b]
                rest = [batch.column(c).slice(i, n) for c in batch.schema.names if c != "text"]
                names = [c for c in batch.schema.names if c != "text"]
                more = [pa.array(langs), pa.array(scores), pa.array(accepted), pa.array(lowest)]
                yield pa.RecordBatch.from_arrays(rest + more, names=names + ["lang_pred", "score", "accepted", "entropy"])

    return run


def _counted(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): how often n-grams of four letters occur in all rows (text, lang) of a language."""
    counts = in_arrow(labelled.where("lang is not null and text is not null").select("lang", "text"), _count, "lang string, gram long, n long")
    return materialise(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


def _learned(counts: DataFrame, most_grams: int) -> LanguageModels:
    """The models of (lang, gram, n), not calibrated."""
    models = {}
    if counts.count() > most_grams:
        models = _mapped_models(counts)
    else:
        table = counts.toArrow()
        langs = np.array(table["lang"].to_pylist(), object)
        keys, n = (table[c].to_numpy() for c in ("gram", "n"))
        for lang in sorted(set(langs)):
            own = langs == lang
            order = np.argsort(keys[own].view(np.uint64))
            models[lang] = KneserNey(keys[own].view(np.uint64)[order], n[own][order])
    return LanguageModels(models)


def _measured(models: LanguageModels, rows: DataFrame) -> tuple[np.ndarray, dict[str, float]]:
    """The loss at each temperature and each language's highest entropy, over all ``rows`` (text, lang) whose lang the models know."""
    losses, highest = np.zeros(len(_TEMPERATURES), np.int64), {}
    if models.langs:
        known = rows.where(F.col("lang").isin(*models.langs) & F.col("text").isNotNull()).select("lang", "text")
        shared = rows.sparkSession.sparkContext.broadcast(models)  # most_grams n-grams at most, or the names of pieces
        got = in_arrow(known, _calibration(shared), _LOSS).groupBy("lang", "t").agg(F.max("highest").alias("highest"), F.sum("loss").alias("loss"))
        for r in got.collect():  # a row for each language and temperature
            if r.lang is None:
                losses[r.t] = r.loss
            else:
                highest[r.lang] = r.highest
        shared.destroy()
    return losses, highest


def train_languages(labelled: DataFrame, calibration: DataFrame, most_grams: int = 4_000_000, spare: float = 0.25) -> LanguageModels:
    """Models learned from all rows (text, lang) of ``labelled``, calibrated on all of ``calibration`` whose lang they know.

    most_grams: up to so many n-grams the models are broadcast, beyond it mapped from the shared folder; results are the same.
    spare: where the highest accepted entropy lies between the highest of ``calibration`` (0) and that of random letters (1).
    """
    out = _learned(_counted(labelled), most_grams)
    losses, highest = _measured(out, calibration)
    if highest:
        out.calibrate(losses, highest, spare)
    return out


def cross_train_languages(labelled: DataFrame, folds: int = 2, most_grams: int = 4_000_000, spare: float = 0.25) -> LanguageModels:
    """Models learned from all rows (text, lang) of ``labelled`` and calibrated on all of them: each fold by models of the other folds.

    folds: by a hash of the text, so that copies are never on both sides. A language that has rows in one fold only is learned, but
    has no limit of entropy, as nothing measures it. most_grams, spare: as for ``train_languages``.
    """
    parts = [labelled.where(fold("text", folds) == f) for f in range(folds)]
    counts = [_counted(part) for part in parts]

    def together(tables: list[DataFrame]) -> DataFrame:
        return tables[0] if len(tables) == 1 else materialise(reduce(DataFrame.union, tables).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")

    losses, highest = np.zeros(len(_TEMPERATURES), np.int64), {}
    for f, part in enumerate(parts):
        more, tops = _measured(_learned(together(counts[:f] + counts[f + 1 :]), most_grams), part)
        losses += more
        for lang, top in tops.items():
            highest[lang] = max(top, highest.get(lang, top))
    out = _learned(together(counts), most_grams)
    if highest:
        out.calibrate(losses, highest, spare)
    return out


def predict_languages(documents: DataFrame, models: LanguageModels) -> DataFrame:
    """``documents`` without text, and lang_pred, score, accepted, entropy (nats a symbol; null where there is no letter)."""
    columns = [c for c in documents.columns if c not in ("text", "lang_pred", "score", "accepted", "entropy")]
    shared = documents.sparkSession.sparkContext.broadcast(models)
    rows = documents.select(*columns, F.col("text").cast("string"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    out = in_arrow(rows, _predict(shared), f"{types}, lang_pred string, score double, accepted boolean, entropy double")
    return out.withColumn("entropy", F.nanvl("entropy", F.lit(None).cast("double")))


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id (or whatever column) as text, modulo n; nulls are fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % n, F.lit(0))


def identify_languages(documents: DataFrame, held_out: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, entropy: learned from rows outside fold ``held_out``, predicted for all.

    Of the labelled folds the first trains the models in full and the next calibrates them.
    """
    train, check = [f for f in range(folds) if f != held_out][:2]
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), fold("doc_id", folds).alias("f"))
    models = train_languages(rows.where(F.col("f") == train), rows.where(F.col("f") == check))
    out = predict_languages(rows.select("doc_id", "text", (F.col("f") == held_out).alias("held_out")), models)
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted", "entropy")
