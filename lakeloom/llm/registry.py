"""The queries of this package and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import chat, decontaminate, jaccard, langid, media, merkle, mixing, pii, quality, repair, secret_scan, substrings, tokencount
from lakeloom.llm.common import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; learned from rows whose crc32(doc_id) mod 3 is not 1, the others are held out."""
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base kinds and those that the method adds."""
    return pii.pii_digest(read(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as an ISO media container, read it back, digest both."""
    return media.media_digest(read(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents' sources to weights 1, 2, 3 in turn, at most 3 epochs each."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text before and after its redactions, the latter counted from the edits."""
    return tokencount.count_redactions(read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation rendered from each participant's side."""
    return chat.rotate(read(spark, sf_dir, "conversations"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and benchmark item that leaked into it."""
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: known forms and what the randomness battery finds."""
    return secret_scan.scan_digest(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, with its source as host and its language as path; learned from `labels`."""
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts linked by a shingle similarity of 0.75 and more."""
    return jaccard.jaccard_groups(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and roots, and whether a tampered third is found out."""
    return merkle.tamper_digest(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged and repaired by the cheapest edits."""
    return repair.repair_digest(read(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 13 words that a document of a smaller id has."""
    return substrings.dedup_digest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_personal_data": op2_personal_data,
    "op3_media_columns": op3_media_columns,
    "op4_source_mix": op4_source_mix,
    "op5_token_counts": op5_token_counts,
    "op6_chat_format": op6_chat_format,
    "op7_decontaminate": op7_decontaminate,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality": op9_quality,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {"op4_source_mix": mixing.SQL, "op6_chat_format": chat.SQL, "op10_jaccard_join": jaccard.SQL, "op11_merkle_manifest": merkle.SQL, "op12_conversation_repair": repair.SQL, "op13_substring_dedup": substrings.SQL}
