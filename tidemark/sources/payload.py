"""Typed, slim views over snapshot payloads. Each consumer has its own coercions, so each has its own view.

Written once at ingest, such a view turns every later scan into a pruned columnar read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.coerce import (
    integer_measure,
    measure,
    not_blank,
    number_from_text,
    rule_measure,
    text_of,
)


def lifecycle_columns() -> list[Column]:
    payload = F.col("payload")
    return [
        rule_measure(payload, "$.mcap").alias("mcap"),
        rule_measure(payload, "$.liquidity").alias("liquidity"),
        rule_measure(payload, "$.holderCount").alias("holders"),
        (not_blank(text_of(payload, "$.mcap")) | not_blank(text_of(payload, "$.liquidity"))).alias("has_economic"),
        measure(payload, "$.mcap").alias("scan_mcap"),
        measure(payload, "$.liquidity").alias("scan_liquidity"),
    ]


def lifecycle_view(snapshots: DataFrame) -> DataFrame:
    """Measures the retirement rules read."""
    return snapshots.select("mint", "observed_at", *lifecycle_columns())


def sum_if_any(left: Column, right: Column) -> Column:
    """Sum in which one missing side counts as zero; NULL when both are missing."""
    zero = F.lit(0)
    return F.when(left.isNotNull() | right.isNotNull(), F.coalesce(left, zero) + F.coalesce(right, zero))


def current_columns() -> list[Column]:
    payload = F.col("payload")
    buys = integer_measure(payload, "$.stats5m.numBuys")
    sells = integer_measure(payload, "$.stats5m.numSells")
    buy_volume = measure(payload, "$.stats5m.buyVolume")
    sell_volume = measure(payload, "$.stats5m.sellVolume")
    launchpad = text_of(payload, "$.launchpad")
    return [
        text_of(payload, "$.name").alias("name"),
        text_of(payload, "$.symbol").alias("symbol"),
        F.when(launchpad != "", launchpad).alias("launchpad"),
        measure(payload, "$.mcap").alias("market_cap"),
        measure(payload, "$.liquidity").alias("liquidity"),
        integer_measure(payload, "$.holderCount").alias("holders"),
        sum_if_any(buys, sells).alias("trades_5m"),
        integer_measure(payload, "$.stats5m.numTraders").alias("traders_5m"),
        buy_volume.alias("buy_volume_5m"),
        sell_volume.alias("sell_volume_5m"),
        sum_if_any(buy_volume, sell_volume).alias("volume_5m"),
    ]


def current_view(snapshots: DataFrame) -> DataFrame:
    """Fields of the current projection. Text that is no number becomes NULL instead of failing the query."""
    return snapshots.select("mint", "observed_at", *current_columns())


def snake_case(key: Column) -> Column:
    words = F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(words, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def numeric_map(stats: Column) -> Column:
    """Top-level numeric entries of a stats object as ``MAP<STRING, DOUBLE>`` with snake-case keys.

    Nested objects carry no statistic of their own and are left out, as are booleans and text that is no number. When
    two keys fall together in snake case the last one wins (``spark.sql.mapKeyDedupPolicy``, see ``session``).
    """
    numbers = F.transform_values(
        F.try_variant_get(stats, "$", "map<string,variant>"),
        lambda _key, value: F.when(
            F.schema_of_variant(value).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"),
            F.try_variant_get(value, "$", "double"),
        ).when(
            F.schema_of_variant(value) == "STRING",
            number_from_text(F.try_variant_get(value, "$", "string")),
        ),
    )
    known = F.filter(F.map_entries(numbers), lambda e: e["value"].isNotNull())
    return F.map_from_entries(F.transform(known, lambda e: F.struct(snake_case(e["key"]), e["value"])))


def history_view(snapshots: DataFrame) -> DataFrame:
    """Measures of the temporal summary."""
    payload = F.col("payload")
    return snapshots.select(
        "mint",
        "observed_at",
        measure(payload, "$.mcap").alias("market_cap"),
        measure(payload, "$.liquidity").alias("liquidity"),
        measure(payload, "$.holderCount").alias("holders"),
        measure(payload, "$.organicScore").alias("organic_score"),
        measure(payload, "$.audit.devMints").alias("dev_mints"),
        measure(payload, "$.audit.devBalancePercentage").alias("dev_balance_pct"),
        measure(payload, "$.audit.topHoldersPercentage").alias("top_holders_pct"),
        numeric_map(F.try_variant_get(payload, "$.stats1h", "variant")).alias("stats_1h"),
    )
