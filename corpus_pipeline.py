"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.

In all stages rows that repeat a doc_id are told apart by their text, rows alike in both
are judged alike, an empty table gives an empty one, very long texts are taken whole, and
all stages but the last keep every column, whatever its name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionloom.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from motionloom.llm.common import SPACES, forget, mark, remove, shared_dir, table
from motionloom.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or empty text has no words and goes, a null lang is one of its own, a null doc_id is judged like any."""
    columns = docs.columns
    return quality.quality(docs, keep=columns).filter("kept").select(*columns)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; one of which no word is left goes, one that had none (null, empty) stays. n_chars follows the text."""
    clean = line_dedup.without_repeats(docs)
    has_word = F.col("text").rlike(SPACES.replace("[", "[^", 1))
    clean = clean.filter((F.col("n_deleted") == 0) | has_word)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates over 5-word shingles.

    Null and empty texts, and rows without doc_id, are nobody's copies and stay; rows that
    repeat a doc_id stay or go together.
    """
    kept = near_dedup.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.filter("doc_id is null"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts, and those without doc_id, hold what their text holds."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text; a null text is encoded as an empty one."""
    return bpe.round_trip(docs, vocabulary())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_runs),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_free),
    ("bpe", encoded),
]

# No SQL: DuckDB has no tokenizer; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's rows are written and read again.

    Once a stage is written, the rows of the one before it and what its operator wrote are removed.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/motionloom/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        since, path = mark(), f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        forget(spark, since)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
