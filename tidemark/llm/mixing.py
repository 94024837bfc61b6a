"""Mixing sources to target weights, by DataFrame functions.

1. A document's size is its number of words. Sources share all words by weight; a source's target stops at ``most``
   times its own words and what is over goes to the others by weight (the level at which the shares settle is found by
   ordering the sources by limit over weight).
2. Each source is cut into blocks of about ``block_rows`` documents by a hash of them. A source is taken whole
   floor(target / words) times; the rest of its target is drawn from its blocks in the order of a keyed permutation,
   whole blocks first, and then documents, in the order of another keyed permutation, from the one block where the quota
   ends (its smallest ones fill the rest).
3. A multivariate-hypergeometric splitting tree deals the draws of blocks to output shards: at each node the exact counts
   of draws by source are split at random between two halves of the shards, down to single shards. Each shard takes the
   next draws of each source's permutation, so shards are disjoint and each has nearly the mix of the whole.
4. Within a shard documents are ordered by a keyed hash.

All draws are keyed by ``seed``: reruns agree. Blocks are ordered in two levels (``prefix_sums``), so no task holds a
source. The tree runs on the driver over a count for each source, or, where there are more than ``tree_sources``, for
each of so many groups of sources; a group's draws are permuted together, which deals them like a tree over its sources.
Plans of more than ``broadcast_sources`` sources are joined by a shuffle.

Null text has no words and empty text neither; null sources are a source of their own, the last one. A source without
words has target 0 and none of it is taken. Repeated rows are hashed alike and stand in the same block, so their number
is the least size of a block; each row has its own draws. Texts are only counted, whatever their length. Ties of hashes
are ordered by all columns. An empty table gives no rows. Columns but doc_id, text, source and those in ``carry`` are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, prefix_sums, row_key

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words parted by ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sid, source, source_size, rows, target from rows (source, size). Weights repeat over the sources in code point order, null last.

    One row for each source; only these rows are ordered as a whole.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("sid", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("double")).withColumn("limit", (most * F.col("source_size")).cast("double"))
    # In ascending limit / weight, sources reach their limits one by one; the level is what is left over by the weight left.
    filled = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    whole = Window.partitionBy()
    by = by.withColumn("total", F.sum("source_size").over(whole).cast("double")).withColumn("weights", F.sum("weight").over(whole))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    by = by.withColumn("level", F.col("left") / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    by = by.withColumn("free", F.col("limit") > F.col("level") * F.col("weight"))
    level = F.coalesce(F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), F.col("sid"), F.col("level")))).over(whole)["level"], F.lit(float("inf")))
    target = F.least(F.col("limit"), level * F.col("weight"))
    return by.select("sid", "source", "source_size", "rows", target.alias("target"))


def splitting_tree(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[shard, source]: the exact block counts of each source dealt to shards by hypergeometric splits."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((shards, len(blocks)), np.int64)

    def split(counts: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = counts
            return
        mid = (lo + hi) // 2
        total = int(counts.sum())
        # The half's size: its share of the blocks, a fraction of a block going by chance.
        share = total * (mid - lo) / (hi - lo)
        size = int(share) + int(rng.random() < share - int(share))
        left = rng.multivariate_hypergeometric(counts, size, method="marginals") if total else counts
        split(left, lo, mid)
        split(counts - left, mid, hi)

    if len(blocks):
        split(np.array(blocks, np.int64), 0, shards)
    return out


def mix_sources(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    shards: int = 64,
    seed: int = 20240229,
    block_rows: int = 64,
    tree_sources: int = 4096,
    broadcast_sources: int = 10_000,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, th (hash of the text, as in ``row_key``), key, size, source, source_size, target, taken, shards: a row for each row of ``documents``.

    taken: words the mix takes of it, repeats counted. shards: the output shard of each time it is taken (an array of
    ``most`` at most); ``deal`` makes the shards' ordered content of it. carry: columns that go along, as c_<name>.
    """
    spark = documents.sparkSession
    along = [F.col(c).alias(f"c_{c}") for c in carry]
    base = documents.select(F.col("doc_id").cast("long"), row_key()[1], F.col("source").cast("string"), word_count(F.col("text")).alias("size"), *along)
    base = base.withColumn("key", F.xxhash64("doc_id", "th", "source", F.lit(seed)))
    base = materialise(base, "sizes")
    targets = materialise(source_targets(base.select("source", "size"), weights, most), "targets")
    n_sources = targets.count()

    # Each source: whole passes, the quota of the rest, and its number of blocks.
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("passes", F.floor(ratio + 1e-9).cast("int")).withColumn("quota", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    plan = plan.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("long"))
    if n_sources <= broadcast_sources:
        plan = F.broadcast(plan)
    rows = base.join(plan, base.source.eqNullSafe(plan.source)).drop(plan.source)
    rows = rows.withColumn("block", F.pmod("key", "blocks"))

    sums = rows.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.first("passes").alias("passes"))
    sums = materialise(prefix_sums(sums, ["sid"], F.xxhash64("sid", "block", F.lit(seed + 1)), {"before": "words"}), "blocks")

    # The draws: each pass draws all blocks of a source, the rest those up to the quota.
    group = F.col("sid") if n_sources <= tree_sources else F.pmod(F.xxhash64("sid", F.lit(seed)), F.lit(tree_sources)).cast("int")
    times = F.col("passes") + (F.col("before") < F.col("quota")).cast("int")
    draws = sums.select(group.alias("gid"), "sid", "block", F.explode(F.sequence(F.lit(1), times)).alias("pass"), times.alias("times")).where("pass <= times").drop("times")
    counts = draws.groupBy("gid").agg(F.count("*").alias("n")).orderBy("gid").collect()  # tree_sources rows at most
    ends = splitting_tree([r.n for r in counts], shards, seed).cumsum(axis=0).T
    cuts = spark.createDataFrame([(r.gid, [int(x) for x in e]) for r, e in zip(counts, ends, strict=True)], "gid int, ends array<long>")
    draws = prefix_sums(draws, ["gid"], F.xxhash64("sid", "block", "pass", F.lit(seed + 4)), {"draw": 1}).join(F.broadcast(cuts), "gid")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("draw")))
    dealt = draws.select("sid", "block", F.struct("pass", shard.alias("shard")).alias("d")).groupBy("sid", "block")
    dealt = dealt.agg(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["shard"]).alias("shards"))  # most at most

    # Whole blocks end within the quota; the block where it ends is drawn document by document.
    inside, edge = F.col("before") + F.col("words") <= F.col("quota"), (F.col("before") < F.col("quota")) & (F.col("before") + F.col("words") > F.col("quota"))
    state = sums.select("sid", "block", F.col("before").alias("block_before"), inside.alias("inside"), edge.alias("edge")).join(dealt, ["sid", "block"], "left")
    rows = rows.join(materialise(state, "dealt"), ["sid", "block"])
    of_block = Window.partitionBy("sid", "block")
    tie = (F.xxhash64("key", F.lit(seed + 2)), F.col("doc_id"), F.col("th"))
    upto = of_block.orderBy(*tie).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.where("edge").withColumn("upto", F.col("block_before") + F.sum("size").over(upto))
    last = last.withColumn("first", F.col("upto") <= F.col("quota"))
    last = last.withColumn("room", F.col("quota") - F.coalesce(F.max(F.when(F.col("first"), F.col("upto"))).over(of_block), F.col("block_before")))
    # What room the next document leaves goes to the smallest ones after it; the last of these counts if half of it fits.
    later = of_block.orderBy("first", "size", *tie).rowsBetween(Window.unboundedPreceding, 0)
    fits = ~F.col("first") & (F.sum("size").over(later) - F.col("size") / 2 < F.col("room"))
    last = last.withColumn("extra", (F.col("first") | fits).cast("int")).drop("upto", "first", "room")
    rest = rows.where("not edge").withColumn("extra", F.col("inside").cast("int"))
    times = F.least(F.col("passes") + F.col("extra"), F.lit(most))
    chosen = F.slice(F.coalesce("shards", F.array().cast("array<int>")), F.lit(1), times)
    out = rest.unionByName(last).withColumn("shards", chosen)
    return out.select("doc_id", "th", "key", "size", "source", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards", *(f"c_{c}" for c in carry))


def deal(mix: DataFrame, seed: int = 20240229) -> DataFrame:
    """A row for each time ``mix`` takes a document: its columns but size, taken and shards, and repeat, shard, position (the order within the shard)."""
    rest = [c for c in mix.columns if c not in ("size", "source_size", "target", "taken", "shards")]
    rows = mix.select(*rest, F.posexplode("shards").alias("repeat", "shard"))
    return rows.withColumn("position", F.xxhash64("key", "repeat", "shard", F.lit(seed + 3)))


def mixed_order(dealt: DataFrame) -> DataFrame:
    """``deal``'s rows as they are to be written: shard after shard in as many partitions as the session shuffles, each in its order."""
    return dealt.repartitionByRange("shard", "position").sortWithinPartitions("shard", "position")
