"""Registry look-ups and key audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def active_by_priority(registry: DataFrame, priority: int = 1) -> DataFrame:
    """Keys under observation at one priority, in key order."""
    return registry.where(F.col("tracking_enabled") & (F.col("priority") == priority)).select("mint").orderBy("mint")


def active_count(registry: DataFrame) -> DataFrame:
    return registry.where("tracking_enabled").agg(F.count("*").alias("active"))


def audit_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that break uniqueness or hold a NULL, with their row count."""
    has_null = F.lit(False)
    for key in keys:
        has_null = has_null | F.col(key).isNull()
    counted = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    return counted.withColumn("has_null", has_null).where((F.col("rows") > 1) | F.col("has_null"))
