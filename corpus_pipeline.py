"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before kept, as a table read back from Parquet, and all but the last return the
columns of documents. Rules that reject a document, near duplicates and benchmark leaks remove whole
documents; personal data (with secrets in quoted assignments) is replaced inside the text, which otherwise stays as it is.

Defined cases: a null or empty text fails the quality rules and goes; a null id is a document of its own, never a
near duplicate; repeated rows (of one id) are judged alike, so all or none of them stay; very long texts go through every stage whole; an
empty table gives an empty result; further columns, also ones with names that an operator uses, stay as they are up to the last
stage, which returns its own columns alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, neardup, packing, pii, quality
from quillon.llm.common import discard, passing, scratch_dir, table
from quillon.llm.vocabularies import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.clean(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars``, where there is one, is that of the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark leaks", benchmark_leaks),
    ("personal data", personal_data),
    ("packed sequences", packed_sequences),
]

#: Edit distances, components and packing have no SQL; tests hold the stages against plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is written to the shared folder, and what it no longer needs deleted."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}-{name.replace(' ', '-')}"
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
