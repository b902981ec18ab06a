"""Preparation and scoring of evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

WEB_URL = r"^(?i:https?)://[^/?#]"


def safe_sources(refs: DataFrame) -> DataFrame:
    """Web references to keep: http or https with a host, first occurrence per URL, title falling back to the URL.

    ``refs`` has ``answer_id, pos, url, title``; ``pos`` of the first occurrence is kept as the order.
    """
    first = (
        refs.where(F.col("url").rlike(WEB_URL))
        .groupBy("answer_id", "url")
        .agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"))
    )
    return first.select(
        "answer_id", "pos", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url")).alias("title"), "url"
    )


def context_size(df: DataFrame, column: str) -> DataFrame:
    """Size of a text in bytes, and rough token counts by characters and by bytes (four to a token, rounded up)."""
    text = F.col(column)
    size = F.octet_length(text)
    return df.withColumns(
        {
            "bytes": size,
            "rough_tokens_chars": F.floor((F.char_length(text) + 3) / 4),
            "rough_tokens_bytes": F.floor((size + 3) / 4),
        }
    )


def score_cases(actual: DataFrame, expected: DataFrame, arguments: Sequence[str]) -> DataFrame:
    """Per case whether all arguments match, missing ones included. ``expected`` decides which cases exist.

    Both sides have ``case_id``, the arguments and ``queried``; False there means that nothing must be queried.
    """
    right = actual.select("case_id", F.lit(True).alias("_answered"), *[F.col(a).alias(f"_{a}") for a in ("queried", *arguments)])
    joined = expected.join(right, "case_id", "left")
    same: Column = F.col("_answered").isNotNull() & F.col("queried").eqNullSafe(F.col("_queried"))
    for argument in arguments:
        same = same & (~F.col("queried") | F.col(argument).eqNullSafe(F.col(f"_{argument}")))
    return joined.select("case_id", F.coalesce(same, F.lit(False)).alias("passed"))


def pass_rate(scored: DataFrame) -> DataFrame:
    counted = scored.agg(F.count_if(F.col("passed")).alias("passed"), F.count("*").alias("cases"))
    return counted.withColumn("pass_rate", F.try_divide("passed", "cases"))
