"""Near-duplicate documents by bottom-k sketches.

A document's set holds its distinct shingles of five words (lower-cased A-Z, split at ASCII white space).
One hash function orders all shingles; a sketch keeps the k smallest hashes.

1. Documents of equal sets form a class; from here on each class counts once.
2. Retained values that only one class has are dropped. The others, rarest first, form inverted lists: a class
   enters only the lists of its first s - c + 1 values, where c values at least are shared by any two linked
   sketches (for full sketches with all but about 1e-7 of certainty at the threshold itself, and for sets smaller
   than k always). A very common value stands last in that order and so starts no long list.
3. In each list every class meets the list's hub, the class whose shingles are the most common ones: the pairs are
   measured on full sets, and links are joined to components.
4. Classes that met the same hub and are of different components yet can be linked only if both have enough in common
   with the hub, or share shingles beside it; those shingles are joined by rarity again, now over full sets. Pairs found
   so are estimated on the union's sketch and confirmed. So no link between components is lost, and a group of m near
   copies costs about m pairs and not m squared.

Null text, empty text and text without words have an empty set and are linked with nothing. Rows of null doc_id take
part; they never name a component (its id is null where no member has an id). Repeated rows are equal sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BYTE_VALUES, components, in_arrow, materialise, mix64, prefix_hash, row_blocks, row_key, span_hash, utf8

#: White space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
_SEPARATOR = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER_VALUES = BYTE_VALUES[_LOWER]
_STEPS = mix64(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 63-bit shingle hashes) of each row of a block of UTF-8 texts."""
    separator = _SEPARATOR[data]
    begins = ~separator
    begins[1:] &= separator[:-1]
    ends = ~separator
    ends[:-1] &= separator[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = ~separator[cut]
    ends[cut - 1] = ~separator[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    word = span_hash(prefix_hash(_LOWER_VALUES[data]), start, end)
    first = np.searchsorted(start, offsets)
    n = max(0, len(word) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(words):
        rolled += word[j : j + n] * _STEPS[j]
    rolled = mix64(rolled) >> np.uint64(1)
    for row in range(len(offsets) - 1):
        a, b = int(first[row]), int(first[row + 1])
        if b - a >= words:
            yield row, np.unique(rolled[a : b - words + 1])
        elif b > a:
            short = (word[a:b] * _STEPS[: b - a]).sum(keepdims=True) + np.uint64(b - a)
            yield row, mix64(short * np.uint64(0xA24BAED4963EE407)) >> np.uint64(1)
        else:
            yield row, np.zeros(0, np.uint64)


_SKETCH = "doc_id long, th long, n_shingles long, fp binary, sketch array<long>"
_SET = "fp binary, shingles array<long>"


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=at[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def _sketches(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in row_blocks(at):
                sizes, prints, kept = [], [], []
                for _, found in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], words):
                    sizes.append(len(found))
                    prints.append(xxhash.xxh128_digest(found) if len(found) else None)
                    kept.append(found[:k])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in ("doc_id", "th")), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), _lists(kept)],
                    names=["doc_id", "th", "n_shingles", "fp", "sketch"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for i, j in row_blocks(at):
                found = [x for _, x in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], words)]
                prints = [xxhash.xxh128_digest(x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), _lists(found)], names=["fp", "shingles"])

    return run


def _allowed(pairs: DataFrame, sketches: DataFrame, k: int, floor: float) -> DataFrame:
    """The pairs (a, b) whose union sketch allows a link."""
    a, b = (sketches.select(F.col("fp").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").withColumn("u", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    return near.where(F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")) >= floor * F.size("u")).select("a", "b")


_HOT_PAIRS = 1024


def _with_sets(pairs: DataFrame, sets: DataFrame, x: str) -> DataFrame:
    """``pairs`` with s<x>, the full set of side ``x``. A class of very many pairs, a hub, has copies of its set for each thousand of them."""
    own = sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"s{x}"))
    hot = materialise(pairs.groupBy(x).agg(F.count("*").alias("c")).where(F.col("c") > _HOT_PAIRS).select(x, F.ceil(F.col("c") / _HOT_PAIRS).cast("int").alias("salts")), "hot", 1)
    n = hot.count()
    if not n:
        return pairs.join(own, x)
    hot = F.broadcast(hot) if n <= 100_000 else hot
    copies = own.join(hot, x, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    dealt = pairs.join(hot, x, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return dealt.join(copies, [x, "salt"]).drop("salt")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, i (shingles in common), na, nb by full sets."""
    both = _with_sets(_with_sets(pairs.select("a", "b"), sets, "a"), sets, "b")
    return both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), F.size("sa").alias("na"), F.size("sb").alias("nb"))


def _links(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _several(rows: DataFrame, key: str) -> DataFrame:
    """The rows of keys under which more than one component (c) stands, and the least n there (lo)."""
    wide = rows.groupBy(key).agg(F.min("c").alias("p"), F.max("c").alias("q"), F.min("n").alias("lo")).where("p <> q").select(key, "lo")
    return rows.drop("lo").join(wide, key)


def _across(rows: DataFrame, keys: list[str], percent: int, columns: list[str]) -> DataFrame:
    """Pairs of rows of equal keys, other components and sizes that allow a link, with their columns (suffixes a and b).

    Sizes are part of the key: those that allow a link lie in the same band or in neighbouring ones.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    one, two = (rows.select(*keys, band.alias("band"), *(F.col(x).alias(f"{x}{y}") for x in ("fp", "c", "n", *columns))) for y in "ab")
    one = one.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    pairs = one.join(two, [*keys, "band"]).drop("band").where("ca <> cb and fpa < fpb")
    return pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 75, k: int = 40, floor: float = 0.35) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, th (hash of the text, as in ``row_key``) for each row of ``documents`` (doc_id, text).

    words: words of a shingle. percent: the least Jaccard similarity of a link. k: sketch size. floor: the share of a
    full sketch that linked documents surely have in common, in the inverted lists and in the union's estimate.
    """
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", "text", row_key()[1])
    sketched = materialise(in_arrow(docs, _sketches(words, k), _SKETCH), "sketches")
    # A class is named by its least id, but its texts are found by a row of it: ids may all be null.
    row = F.min(F.struct(row_key()[0], "th")).alias("row")
    classes = sketched.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("id"), row, F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    n_docs = sketched.count()
    classes = materialise(classes, "classes", n_docs, 25_000)

    values = classes.select("fp", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    # Counts are written before they are joined, so that the join can be split at a value that very many classes have.
    shared = materialise(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "shared", n_docs * k // 2)
    entries = values.join(shared, "v")
    ordered = entries.groupBy("fp").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.sum("df").alias("w"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("own"))  # k entries at most
    share = F.when(F.col("s") < k, F.ceil(F.lit(0.6) * F.col("s"))).otherwise(F.lit(int(floor * k)))
    m = F.size("own")
    lists = (
        ordered.withColumn("m", m)
        .withColumn("prefix", (F.col("m") - F.greatest(share, F.lit(1)) + 1).cast("int"))
        .where("prefix > 0")
        .select("fp", "n", "w", F.explode(F.slice("own", F.lit(1), F.col("prefix"))).alias("e"))
        .select("fp", "n", "w", F.col("e.v").alias("v"))
    )
    lists = materialise(lists, "lists", n_docs * k)
    n_lists = lists.count()

    listed = lists.select("fp").distinct().join(classes.select("fp", "row"), "fp").select("row.k", "row.th")
    texts = docs.withColumn("k", row_key()[0]).join(listed, ["k", "th"], "left_semi").select("text")
    sets = materialise(in_arrow(texts, _sets(words), _SET).dropDuplicates(["fp"]), "sets", n_docs, 5_000)
    # A class weighs as much as its shingles (of a wider sketch) are common: the middle of a family weighs most.
    wide = sets.select("fp", F.explode(F.slice("shingles", 1, 4 * k)).alias("s"))
    often = materialise(wide.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "often", n_docs * 2 * k)
    weights = wide.join(often, "s").groupBy("fp").agg(F.sum("df").alias("w"))
    lists = materialise(lists.drop("w").join(weights, "fp", "left").withColumn("w", F.coalesce("w", F.lit(0))), "lists", n_lists, 10_000)

    # The hub of a list is its heaviest member, or else the heaviest hub that its members have met, if that is much alike.
    top = lists.groupBy("v").agg(F.max(F.struct("w", "fp", "n")).alias("top"), F.count("*").alias("members")).where("members > 1").drop("members")
    best = lists.join(top, "v").groupBy("fp").agg(F.max("top").alias("best"))
    hubs = lists.join(best, "fp").groupBy("v").agg(F.max(F.struct("w", "fp", "n")).alias("one"), F.max("best").alias("two")).join(top, "v", "left_semi")
    hubs = materialise(hubs.select("v", *(F.col(f"{x}.fp").alias(f"fp{x}") for x in ("one", "two"))), "hubs", n_lists)
    moved = hubs.where("fpone <> fptwo")
    moved = _measured(moved.select(F.col("fpone").alias("a"), F.col("fptwo").alias("b")).distinct(), sets)
    moved = materialise(moved.where(2 * F.col("i") >= F.greatest("na", "nb")).select(F.col("a").alias("fpone"), F.col("b").alias("fptwo"), F.lit(True).alias("moved")), "moved", n_lists, 2_000)
    hubs = hubs.join(moved, ["fpone", "fptwo"], "left")
    hubs = hubs.select("v", F.when(F.col("moved"), F.col("fptwo")).otherwise(F.col("fpone")).alias("h"))
    met = lists.join(hubs, "v").select("fp", "n", "h").distinct()
    pairs = materialise(met.where("fp <> h").select(F.least("fp", "h").alias("a"), F.greatest("fp", "h").alias("b")).distinct(), "pairs", n_lists)
    n_pairs = pairs.count()
    measured = materialise(_measured(pairs, sets), "measured", n_pairs, 2_000)
    links = _links(measured, percent)
    found = materialise(components(links, n_pairs), "found", 2 * n_pairs)

    # What is left are pairs of other components that met the same hub h: |x & y| = |x & y & h| + |x & y - h|, so either
    # min(|x & h|, |y & h|) is enough for a link, or they share something beside h.
    met = met.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("root", "fp")).drop("root")
    met = materialise(met.where("fp <> h"), "met", n_lists)
    own = measured.select(F.col("a").alias("fp"), F.col("b").alias("h"), "i").union(measured.select("b", "a", "i"))
    share = lambda n: F.ceil(F.lit(percent) * n / (100 + percent))  # noqa: E731  least overlap of a link of two sets of n in all
    known = met.join(own, ["fp", "h"])
    known = materialise(_several(known, "h"), "known", n_lists)
    partner = F.greatest("lo", F.ceil(F.lit(percent) * F.col("n") / 100))
    close = _several(known.where(F.col("i") >= share(F.col("n") + partner)), "h")
    rest = _across(close, ["h"], percent, ["i"]).where(F.least("ia", "ib") >= share(F.col("na") + F.col("nb"))).select(F.col("fpa").alias("a"), F.col("fpb").alias("b"))

    # Beside the hub: a prefix-filtered join of what is left of the sets, rarest first.
    left, hub = (sets.select(F.col("fp").alias(x), F.col("shingles").alias(f"s{x}")) for x in ("fp", "h"))
    beside = known.join(left, "fp").join(hub, "h").select("h", "fp", "n", "c", "i", "lo", F.explode(F.array_except("sfp", "sh")).alias("s"))
    beside = materialise(beside, "beside")
    common = beside.groupBy("h", "s").agg(F.count("*").alias("df"), F.min("c").alias("p"), F.max("c").alias("q")).where("p <> q").select("h", "s", "df")
    common = materialise(common, "common")
    kept = beside.join(common, ["h", "s"]).groupBy("h", "fp", "n", "c", "i", "lo").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("own"))  # a document's shingles at most
    needed = F.greatest(share(F.col("n") + partner) - F.col("i"), F.lit(1))
    kept = kept.withColumn("prefix", (F.size("own") - needed + 1).cast("int")).where("prefix > 0")
    kept = kept.select("h", "fp", "n", "c", F.size("own").alias("w"), F.explode(F.slice("own", F.lit(1), F.col("prefix"))["s"]).alias("s"))
    kept = materialise(kept.withColumn("hs", F.struct("h", "s")).drop("h", "s"), "kept")
    n_kept = kept.count()
    # Families within families: the heaviest of each such list first, all others only where components remain.
    top = kept.groupBy("hs").agg(F.max(F.struct("w", "fp", "n", "c")).alias("top"))
    star = kept.join(top, "hs").where("c <> top.c").where(100 * F.least("n", "top.n") >= percent * F.greatest("n", "top.n"))
    star = star.select(F.least("fp", "top.fp").alias("a"), F.greatest("fp", "top.fp").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    measured = measured.union(materialise(_measured(materialise(star, "star", n_kept), sets), "measured", n_kept, 2_000))
    links = _links(measured, percent)
    found = materialise(components(links, n_pairs + n_kept), "found", 2 * (n_pairs + n_kept))
    pairs = measured.select("a", "b")
    kept = kept.drop("c").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("root", "fp")).drop("root")
    beyond = materialise(_across(_several(kept, "hs"), ["hs"], percent, []).select("fpa", "fpb"), "beyond")
    rest = rest.union(beyond)

    rest = materialise(rest.distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    n_rest = rest.count()
    more = materialise(_links(_measured(materialise(_allowed(rest, classes, k, floor), "near", n_rest, 10_000), sets), percent), "links", n_rest, 2_000)
    if not more.isEmpty():
        found = components(links.union(more))

    rooted = classes.select("fp", "id").join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("c"))
    least = rooted.groupBy("c").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "c").select("fp", "component_id")
    out = sketched.drop("sketch").join(named, "fp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "th")
