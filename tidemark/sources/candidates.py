"""Candidate keys from landed discovery feeds. Every occurrence is kept; admission removes duplicates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.coerce import string_only


def _items(raw: DataFrame) -> DataFrame:
    body = F.try_parse_json("body")
    return raw.select(F.explode(F.try_variant_get(body, "$", "array<variant>")).alias("item"))


def candidates_from_recent(raw: DataFrame) -> DataFrame:
    """``body`` is a JSON array of items; each item with a non-empty text ``id`` is a candidate."""
    return _items(raw).select(string_only(F.col("item"), "$.id").alias("mint")).where("mint <> ''")


def candidates_from_pools(raw: DataFrame) -> DataFrame:
    """``body`` is a JSON array of pools; both sides of a pool are candidates, a side without address is skipped."""
    sides = F.array(
        string_only(F.col("item"), "$.token_x.address"),
        string_only(F.col("item"), "$.token_y.address"),
    )
    return _items(raw).select(F.explode(sides).alias("mint")).where("mint <> ''")


def candidates_from_messages(raw: DataFrame) -> DataFrame:
    """``body`` is one JSON message; a message whose ``mint`` is not a non-empty text is skipped."""
    return raw.select(string_only(F.try_parse_json("body"), "$.mint").alias("mint")).where("mint <> ''")


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Label candidates by source; ``source_order`` is the position of the source in the mapping."""
    labelled = [
        frame.select(F.lit(label).alias("source"), F.lit(order).alias("source_order"), "mint")
        for order, (label, frame) in enumerate(sources.items())
    ]
    result = labelled[0]
    for frame in labelled[1:]:
        result = result.unionByName(frame)
    return result
