"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage works on all rows that the one before has kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import byte_bpe, decontamination, language, simhash, substrings
from tidemark.llm.common import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised by a model of all rows that name theirs; rows without a text or a letter go, and
    those whose letters are in none of its languages. No certainty between languages is asked for, since a short clean text may
    be of any. Without any row that names a language all texts with a letter stay."""
    model = language.train(docs, learns=lambda i: True)
    return language.identified(docs, model, fitting=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that SimHash links connect: the one with the smallest id."""
    return simhash.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 20 words that also start earlier; a document of which nothing is left goes."""
    return substrings.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, also not with other numbers, names and units."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining text, with digests of the ids and of what they decode to."""
    return byte_bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

# Language models, components, exact windows of words and byte-pair merges are beyond SQL; tests/llm holds the stages
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent))
    root = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        out = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
