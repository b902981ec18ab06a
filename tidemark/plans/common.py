"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.config import RuleConfig

# The derived history has no minute-scale life: one contract minute is stretched to one hour.
CFG = RuleConfig().scaled(60, max_changes=2)


def micros(df: DataFrame) -> DataFrame:
    """Instants as epoch microseconds in ``<name>_us``, so that both engines compare plain numbers."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampType):
            columns.append(F.unix_micros(field.name).alias(f"{field.name}_us"))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: the engines add in different orders."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def longs(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, whatever width an aggregate gave them."""
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    return longs(rounded(micros(df), digits))
