"""A quality classifier on document statistics.

1. Statistics of the whole text (``STATISTICS``), computed once for each document in the workers.
2. They are standardised by the labelled rows and mapped by random Fourier features, whose inner products approximate a
   Gaussian kernel.
3. Ridge regression on the labels: each partition sums its normal equations, the sums are added row by row of the
   matrix, and the driver solves one system of ``features`` + 1 unknowns.
4. Isotonic calibration: labelled rows kept out of 3 are binned by raw score, and pooled adjacent violators over the
   bins give a rising map from raw scores to shares of label 1.

Labels are the only thing learned from; ids, sources and languages are no inputs. Null and empty texts have zero
statistics and are scored like any other text. Without labels every score is 0.5. Rows of ``labels`` with null label or
unknown id are ignored; an id labelled twice counts twice. Repeated rows are scored alike, each of them, and train as often as
they occur; rows of equal raw scores get equal scores. Very long texts are counted in full; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BYTE_VALUES, in_arrow, materialise, prefix_hash, row_blocks, span_hash, utf8
from tidemark.llm.langid import fold

#: Names in order; shares are of the characters unless said otherwise.
STATISTICS = (
    "log_bytes", "letters", "upper", "digits", "space", "stops", "marks", "symbols", "beyond_ascii", "log_words", "mean_word",
    "long_words", "distinct_words", "repeats_previous", "distinct_pairs", "marked_words", "capital_words", "log_lines", "distinct_lines", "byte_entropy",
)

_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_CLASS = np.full(256, 7, np.uint8)  # other symbols
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r", b".,;:", b"!?'\"()-")):
    _CLASS[list(_chars)] = _k
_CLASS[0x80:] = 6


def _per_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive starts (n + 1 of them)."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def _distinct(row: np.ndarray, keys: np.ndarray, rows: int) -> np.ndarray:
    """Number of distinct keys in each row."""
    if not len(keys):
        return np.zeros(rows)
    order = np.lexsort((keys, row))
    r, k = row[order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return np.bincount(r[new], minlength=rows).astype(np.float64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[rows, len(STATISTICS)] of a block of UTF-8 texts."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    kind = _CLASS[data]
    share = np.maximum(size, 1)
    counts = np.stack([_per_row(kind == k, offsets) for k in range(8)], 1)
    letters, upper, digits, space, stops, marks, beyond, other = (counts / share[:, None]).T

    white = _WHITE[data]
    starts_at = offsets[:-1][size > 0]
    begins = ~white
    begins[1:] &= white[:-1]
    begins[starts_at] = ~white[starts_at]
    ends = ~white
    ends[:-1] &= white[1:]
    lasts = offsets[1:][size > 0] - 1
    ends[lasts] = ~white[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    words = np.diff(first).astype(np.float64)
    row = np.repeat(np.arange(rows), np.diff(first))
    prefix = prefix_hash(BYTE_VALUES[data])
    word = span_hash(prefix, start, end)
    length = (end - start).astype(np.float64)
    at_least_one = np.maximum(words, 1)
    same = np.zeros(len(word))
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    pair = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]
    inside = row[1:] == row[:-1]
    pairs = np.maximum(words - 1, 1)
    ending = kind[end - 1]
    marked = (ending >= 5) & (ending != 6)
    capital = kind[start] == 1

    breaks = np.flatnonzero(data == 0x0A)
    line_row = np.searchsorted(offsets, breaks, side="right") - 1
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    line_of = np.concatenate([np.arange(rows), line_row])
    order = np.argsort(line_start, kind="stable")
    line_start, line_of = line_start[order], line_of[order]
    line_end = np.append(line_start[1:], len(data))
    line_end = np.minimum(line_end, offsets[1:][line_of])
    lines = np.bincount(line_of, minlength=rows).astype(np.float64)
    distinct_lines = _distinct(line_of, span_hash(prefix, np.minimum(line_start, line_end), line_end), rows) / np.maximum(lines, 1)

    joint = np.repeat(np.arange(rows), np.diff(offsets)) * 256 + data
    histogram = np.bincount(joint, minlength=256 * rows).reshape(rows, 256) / share[:, None]
    entropy = -(histogram * np.log(np.where(histogram > 0, histogram, 1))).sum(1)
    out = [
        np.log1p(size), letters, upper, digits, space, stops, marks, other, beyond, np.log1p(words), _per_row(length, first) / at_least_one,
        _per_row(length > 14, first) / at_least_one, _distinct(row, word, rows) / at_least_one, _per_row(same, first) / at_least_one,
        _distinct(row[1:][inside], pair[inside], rows) / pairs, _per_row(marked, first) / at_least_one, _per_row(capital, first) / at_least_one,
        np.log1p(lines), distinct_lines, entropy,
    ]
    return np.stack(out, 1)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        names = [c for c in batch.schema.names if c != "text"]
        for i, j in row_blocks(at, 1 << 19):
            found = statistics(data[at[i] : at[j]], at[i : j + 1] - at[i])
            n = found.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * n, n, dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in names] + [lists], names=[*names, "stats"])


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, stats (array<double> in the order of STATISTICS)."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_arrow(docs, _statistics, "doc_id long, stats array<double>")


class Model:
    """Random Fourier features, ridge weights and the calibration map."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int, width: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / width, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.at, self.share = np.array([0.0]), np.array([0.5])

    def map(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.std, -6, 6)
        z = np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.map(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.at, self.share), 0, 1)


def pool_adjacent(x: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising shares ones / n over ordered x by pooling adjacent violators: knots (x, share), two for each pool."""
    pools: list[list[float]] = []
    for a, k, m in zip(x, ones, n, strict=True):
        pools.append([a, a, float(k), float(m)])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            lo, _, k0, m0 = pools[-2]
            pools[-2:] = [[lo, pools[-1][1], k0 + pools[-1][2], m0 + pools[-1][3]]]
    xs = [p for lo, hi, _, _ in pools for p in ((lo,) if lo == hi else (lo, hi))]
    ys = [k / m for lo, hi, k, m in pools for _ in ((0,) if lo == hi else (0, 1))]
    return np.array(xs), np.array(ys)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().reshape(-1, len(STATISTICS))


def _equations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = model.map(_matrix(batch))
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
            own = z.T @ np.concatenate([z, y[:, None]], 1)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["row", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.add.reduce([np.array(x.as_py()) for x in table["sums"]])
    return pa.table({"row": pa.array([table["row"][0].as_py()], pa.int32()), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})


def _scored(model: Model, raw_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _matrix(batch)
            names = [c for c in batch.schema.names if c != "stats"]
            value = model.raw(stats) if raw_only else model.score(stats)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(value)], names=[*names, "score"])

    return run


def fit_quality(labelled: DataFrame, features: int = 384, width: float = 4.5, ridge: float = 1e-3, bins: int = 400, seed: int = 7) -> Model:
    """A model from rows (doc_id, stats, label). A fifth of them, by a hash of the id, calibrates; the others fit.

    features: number of random features. width: standard deviation of the kernel. ridge: penalty a row. bins: of the
    calibration, over raw scores from -1 to 2.
    """
    d = len(STATISTICS)
    aside = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0
    moments = labelled.select(*(f(F.col("stats")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))), F.count("*").alias("n"), F.avg("label").alias("p")).first()
    model = Model(np.array([moments[f"m{i}"] or 0.0 for i in range(d)]), np.array([moments[f"s{i}"] or 0.0 for i in range(d)]), features, width, seed)
    if not moments.n:
        return model
    model.share = np.array([moments.p])
    sums = in_arrow(labelled.where(~aside).select("stats", "label"), _equations(model), "row int, sums array<double>")
    rows = sums.groupBy("row").applyInArrow(_add, "row int, sums array<double>").orderBy("row").collect()  # features + 1 rows
    if not rows:
        return model
    m = np.array([r.sums for r in rows])
    a, b = m[:, :-1], m[:, -1]
    model.weights = np.linalg.solve(a + ridge * a[-1, -1] * np.diag([1 / len(a)] * (len(a) - 1) + [1e-9]), b)
    raw = in_arrow(labelled.where(aside).select("stats", "label"), _scored(model, True), "label double, score double")
    held = raw.groupBy(F.round(F.least(F.greatest("score", F.lit(-1.0)), F.lit(2.0)) * bins / 3).alias("bin")).agg(F.avg("score").alias("x"), F.sum("label").alias("ones"), F.count("*").alias("n"))
    held = held.orderBy("bin").collect()  # bins + 1 rows at most
    if held:
        model.at, model.share = pool_adjacent(np.array([r.x for r in held]), np.array([r.ones for r in held]), np.array([r.n for r in held]))
    return model


def score_quality(documents: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels (doc_id, quality) outside fold ``held_out`` are learned from."""
    stats = materialise(document_statistics(documents), "statistics")
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label")).where("label is not null and doc_id is not null")
    known = known.where(fold("doc_id", folds) != held_out)
    labelled = materialise(stats.join(known, "doc_id"), "labelled")
    model = fit_quality(labelled)
    scored = in_arrow(stats, _scored(model, False), "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
