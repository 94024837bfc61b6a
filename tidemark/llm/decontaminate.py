"""Benchmark decontamination as a prefix-filtered set join, by DataFrame functions.

Texts are lower-cased (A-Z) and cut into words. An item's windows are its runs of ``size`` words, or all its words if it
has fewer. A window occurs in a document where the same words stand in the same order. All of a window's words must be
there, so its rarest word (fewest windows have it; then the longest, then the first in order) is its prefix: document
words are joined with prefixes alone. Where one meets, the word's place in the window gives the only possible start;
starts before the text or past its length are dropped, and the rest is compared word by word.

The prefix table is broadcast while the benchmark has at most ``broadcast_windows`` distinct windows. Beyond that, words
that are no prefix are dropped first (by a broadcast of the prefixes' words, of which there are at most as many as words
in use; up to ``broadcast_tokens``), and the others joined by a shuffle on the prefix and its neighbour. Very long texts
and ties of rarity change nothing. Null texts and texts without words have no words and no hits; null items have no windows. Repeated
items count by their ids; repeated documents have equal results, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, row_key

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: runs of digits, lower-cased letters and characters beyond ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _BETWEEN, -1), "")


def item_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """item_id, w (a window's words, space between): distinct."""
    items = benchmark.select("item_id", words(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    runs = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return runs.select("item_id", F.concat_ws(" ", F.slice("words", F.col("i") + 1, F.lit(size))).alias("w")).distinct()


def prefixes(windows: DataFrame) -> DataFrame:
    """token, place, length, w: each distinct window with its rarest word and that word's place."""
    distinct = windows.select("w").distinct()
    terms = distinct.select("w", F.posexplode(F.split("w", " ")).alias("place", "token"))
    rarity = terms.select("w", "token").distinct().groupBy("token").agg(F.count("*").alias("df"))
    ranked = terms.join(rarity, "token").groupBy("w").agg(F.min(F.struct("df", (-F.length("token")).alias("l"), "token", "place")).alias("best"), F.count("*").alias("length"))
    return ranked.select(F.col("best.token").alias("token"), F.col("best.place").alias("place"), F.col("length").cast("int").alias("length"), "w")


def covered(spans: Column) -> Column:
    """How many whole numbers lie in the union of an array of structs (a, b), b exclusive."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda s: s["n"])


def _joined_by_pairs(texts: DataFrame, prefix: DataFrame, broadcast_tokens: int) -> DataFrame:
    """Document words with the prefixes they meet, by a shuffle on two neighbouring words: a prefix and the word after it,
    or before it where it is a window's last. Words that are no prefix are left out before, if the prefixes can be broadcast."""
    parts = F.split("w", " ")
    side = F.when(F.col("place") + 1 < F.col("length"), 1).when(F.col("place") > 0, -1).otherwise(0)
    prefix = prefix.withColumn("side", side).withColumn("other", F.when(F.col("side") == 0, "").otherwise(F.get(parts, F.col("place") + F.col("side"))))
    around = F.transform("words", lambda x, i: F.struct(x.alias("token"), F.coalesce(F.get("words", i + 1), F.lit("")).alias("after"), F.coalesce(F.get("words", i - 1), F.lit("")).alias("before")))
    terms = texts.select("k", "th", "n", F.posexplode(around).alias("p", "x")).select("k", "th", "n", "p", "x.*")
    tokens = prefix.select("token").distinct()
    if tokens.count() <= broadcast_tokens:
        terms = terms.join(F.broadcast(tokens), "token", "left_semi")
    keys = F.array(*(F.struct(F.lit(s).alias("side"), c.alias("other")) for s, c in ((1, F.col("after")), (-1, F.col("before")), (0, F.lit("")))))
    terms = terms.select("k", "th", "n", "p", "token", F.explode(keys).alias("key")).select("k", "th", "n", "p", "token", "key.*")
    return terms.join(prefix, ["token", "side", "other"])


def find_contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_windows: int = 200_000, broadcast_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated, and the row key, for every row of (doc_id, text)."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.select("doc_id", *row_key(), "text")
    windows = materialise(item_windows(benchmark, size), "windows")
    prefix = materialise(prefixes(windows), "prefixes")
    texts = docs.select("k", "th", words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    if prefix.count() <= broadcast_windows:
        terms = texts.select("k", "th", "n", F.posexplode("words").alias("p", "token"))
        met = terms.join(F.broadcast(prefix), "token")
    else:
        met = _joined_by_pairs(texts, prefix, broadcast_tokens)
    start = F.col("p") - F.col("place")
    met = met.where((start >= 0) & (start + F.col("length") <= F.col("n")))
    met = met.groupBy("k", "th").agg(F.collect_set(F.struct(start.alias("a"), (start + F.col("length")).alias("b"), "w")).alias("met"))  # of one document

    both = docs.join(met, ["k", "th"], "left").withColumn("words", words(F.col("text")))
    found = F.filter(F.coalesce("met", F.array().cast("array<struct<a:int,b:int,w:string>>")), lambda c: F.concat_ws(" ", F.slice(F.col("words"), c["a"] + 1, c["b"] - c["a"])) == c["w"])
    both = both.select("doc_id", "k", "th", F.size("words").cast("long").alias("n_words"), found.alias("found"))
    both = both.select("doc_id", "k", "th", "n_words", covered(F.transform("found", lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b")))).cast("long").alias("n_hit"), F.array_distinct(F.transform("found", lambda c: c["w"])).alias("ws"))
    both = materialise(both, "hits")

    items = both.where("n_hit > 0").select("k", "th", F.explode("ws").alias("w")).distinct().join(windows, "w")
    items = items.groupBy("k", "th").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    out = both.join(items, ["k", "th"], "left")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), (F.col("n_hit") > 0).alias("contaminated"), "k", "th")
