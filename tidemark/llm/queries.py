"""The queries of the training-data operators: (spark, folder of tables) -> DataFrame, and DuckDB SQL where it can tell the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import find_contamination
from tidemark.llm.langid import identify_languages
from tidemark.llm.license_scan import scan_licenses
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix_sources
from tidemark.llm.mpegts import media_features
from tidemark.llm.pii import find_personal_data, span_text
from tidemark.llm.quality import score_quality
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.token_files import token_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The tokeniser's file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in passages of the benchmark."""
    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of documents that stand in repeated strings of 200 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, filed as <source>/<id / 1000>/<id / 10>/<id>."""
    documents = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), *((F.floor(F.col("doc_id") / n)).cast("string") for n in (1000, 10)), F.col("doc_id").cast("string"))
    return scan_licenses(documents, path)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans, and those with what the trees add."""
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, described as read back."""
    return token_index(table(spark, sf_dir, "documents"), vocabulary())


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as transport streams, described as read back."""
    out = media_features(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return identify_languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("th")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, in words."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_personal_data": op5_personal_data,
    "op6_token_files": op6_token_files,
    "op7_media": op7_media,
    "op8_language_id": op8_language_id,
    "op9_minhash": op9_minhash,
    "op10_mixing": op10_mixing,
}

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS ws FROM documents),
i AS (SELECT item_id, ws, least(10, len(ws)) AS size FROM (SELECT item_id, {_WORDS.format('text')} AS ws FROM benchmark) WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(ws[p:p + size - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS p FROM i)),
lengths AS (SELECT DISTINCT size FROM win),
runs AS (SELECT doc_id, p, size, array_to_string(ws[p:p + size - 1], ' ') AS w FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM d, lengths WHERE len(ws) >= size)),
hits AS (SELECT runs.*, item_id FROM runs JOIN win USING (size, w)),
covered AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM (SELECT doc_id, p, unnest(range(0, size)) AS o FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
