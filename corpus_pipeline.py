"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept and its decision takes effect: texts whose language is not accepted go, one
document of each near-duplicate group stays, documents that hold a passage of the benchmark go, sources are mixed to
their target weights (a document is repeated as often as the mix takes it), and what is left becomes token files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, row_key
from tidemark.llm.decontaminate import find_contamination
from tidemark.llm.langid import cross_train_languages, predict_languages
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import deal, mix_sources, mixed_order
from tidemark.llm.queries import table, vocabulary
from tidemark.llm.token_files import token_index

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, *row_key())


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is accepted, by models of all labelled ones; lang becomes the predicted one."""
    out = predict_languages(docs.withColumn("own", F.col("text")), cross_train_languages(docs)).where("accepted")
    return out.select("doc_id", F.col("own").alias("text"), F.col("lang_pred").alias("lang"), "source", "n_chars")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the one of least id."""
    kept = near_duplicates(docs).where("kept").select(row_key()[0], "th").distinct()
    return _keyed(docs).join(kept, ["k", "th"], "left_semi").dropDuplicates(["k", "th"]).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    bad = find_contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("k", "th")
    return _keyed(docs).join(bad, ["k", "th"], "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, written shard after shard in the shards' own order."""
    rest = [c for c in COLUMNS if c not in ("doc_id", "source")]
    dealt = mixed_order(deal(mix_sources(docs, carry=tuple(rest))))
    return dealt.select("doc_id", F.col("c_text").alias("text"), F.col("c_lang").alias("lang"), "source", F.col("c_n_chars").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write what is left as token files, in the order in which the mix was written, and describe them as read back."""
    try:
        part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long")
        docs = docs.select("doc_id", "text", part.alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # a frame that was read from no file has no order but its ids
        return token_index(docs, vocabulary())
    return token_index(docs, vocabulary(), order=("part", "file", "row"))


STAGES = [
    ("language ID", identify),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token-ID output", tokens),
]

#: Language models and hashes are not for SQL. tests/llm tests each operator; a test of the whole run is still missing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a scratch table for the next."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
