"""The corpus pipeline: documents in, a mixture plan out. Each stage works on all that the one before it kept.

quality    documents that the classifier rejects go (so do those without a word).
near_dup   one document of each group of near duplicates stays, the one with the least id.
leaks      documents that hold a benchmark item go.
secrets    stretches of text that hold secrets are masked; every document stays.
mix        how often each document is taken, by source.

Decisions are made by row, under a key that each stage gives its own rows, so a null or repeated doc_id changes nothing: a row goes by what
is found in it. Other columns, with whatever names, are carried along; empty tables give empty results. Of near duplicates the row with the least doc_id stays, one without an id last; exact repeats are near duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontaminate, jaccard, mixing, quality, secret_scan
from lakeloom.llm.common import read, stored


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key for each row, and the key's name. Keys follow from how files are packed into tasks, which may change between two scans; so the rows
    are written with their keys once, and all that a stage does reads that table."""
    row = "__row"
    while any(c.lower().startswith(row) for c in docs.columns):
        row += "_"
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def _without(keyed: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not among those of `gone` (one column)."""
    out = stored(gone.toDF(f"{row}_gone"), "gone")
    return keyed.join(out, F.col(row) == F.col(f"{row}_gone"), "left_anti").drop(row)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier keeps, columns as they came. Null and wordless texts go; rows that are alike fare alike."""
    keyed, row = _keyed(docs)
    scored = quality.score(keyed, read(spark, sf_dir, "labels"), row_col=row)
    return _without(keyed, row, scored.where(~F.col("keep")).select(row))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id, null ids last. Texts without a word have no copies and stay."""
    keyed, row = _keyed(docs)
    groups = stored(jaccard.jaccard_groups(keyed, row).select(F.col(row).alias("row"), "component_id"), "groups")
    shared = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("component_id").alias("c"))
    ids = keyed.select(F.col(row).alias("k"), F.col("doc_id").alias("d"))
    members = groups.join(shared, F.col("component_id") == F.col("c"), "left_semi").join(ids, F.col("row") == F.col("k"))
    order = F.struct(F.col("d").isNull(), "d", "row")
    first = members.groupBy(F.col("component_id").alias("c")).agg(F.min(order)["row"].alias("first"))
    return _without(keyed, row, members.join(first, F.col("component_id") == F.col("c")).where(F.col("row") != F.col("first")).select("row"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item. Null and empty texts hold none and stay."""
    keyed, row = _keyed(docs)
    return _without(keyed, row, decontaminate.find_leaks(keyed, read(spark, sf_dir, "benchmark"), row).select(row).distinct())


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All docs, with secrets masked and n_chars, where there is such a column, counted anew. Null texts stay null."""
    found = secret_scan.scan(docs, keep=True)
    clean = secret_scan.redact(F.col("kept.text"), secret_scan.merged(F.col("base"), F.col("random")))
    out = found.withColumn("kept", F.col("kept").withField("text", clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("kept", F.col("kept").withField("n_chars", F.length("kept.text").cast(docs.schema["n_chars"].dataType)))
    return out.select("kept.*").select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each doc: how often it is taken. Null sources are one source."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("leaks", leak_stage),
    ("secrets", secret_stage),
    ("mix", mix_stage),
]

#: Trained models, shingle joins and latent retrieval are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage returns is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
