"""The corpus pipeline: language ID, near-duplicates, decontamination, PII, SentencePiece.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet to the
shared folder and read again as the next one's docs. All but the last give the columns of
documents. No stage can be expressed in SQL as a whole, so ``ORACLE_SQL`` is None and the
stages are held against brute force in tests.

Defined results. Null texts are rejected by the first stage (no letter). A null doc_id takes
no part in near-duplicates and stays. Repeated rows go through every stage alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, langid, neardup, pieces, pii
from tideline.plans.scratch import stored

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from the labelled documents."""
    return langid.identify(docs, langid.train(docs)).where(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of least doc_id."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, surrogates for personal data; n_chars counts the new text."""
    out = pii.replace(docs, pii.session_key(spark), count=None)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids and whether decoding gives the text again."""
    return pieces.encode(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
