"""Fixed table schemas. Payloads are VARIANT so that unknown keys survive untouched."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the three stored tables.
REGISTRY = T.StructType(
    [
        T.StructField("mint", T.StringType(), False),
        T.StructField("dev", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("decimals", T.IntegerType()),
        T.StructField("icon", T.StringType()),
        T.StructField("twitter", T.StringType()),
        T.StructField("website", T.StringType()),
        T.StructField("token_program", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("first_pool_id", T.StringType()),
        T.StructField("first_pool_created_at", T.TimestampType()),
        T.StructField("mint_authority_disabled", T.BooleanType()),
        T.StructField("freeze_authority_disabled", T.BooleanType()),
        T.StructField("tracking_enabled", T.BooleanType(), False),
        T.StructField("priority", T.IntegerType(), False),
        T.StructField("first_observed_at", T.TimestampType()),
        T.StructField("last_polled_at", T.TimestampType()),
        T.StructField("last_changed_at", T.TimestampType()),
        T.StructField("source_updated_at", T.StringType()),
        T.StructField("disabled_at", T.TimestampType()),
        T.StructField("disabled_reason", T.StringType()),
    ]
)

SNAPSHOTS = T.StructType(
    [
        T.StructField("mint", T.StringType(), False),
        T.StructField("observed_at", T.TimestampType(), False),
        T.StructField("payload", T.VariantType(), False),
    ]
)

RULE_STATE = T.StructType(
    [
        T.StructField("mint", T.StringType(), False),
        T.StructField("rule_key", T.StringType(), False),
        T.StructField("scanned_through", T.TimestampType(), False),
    ]
)

# One landed provider response: the items it held and the single instant it was received.
POLL_RESPONSES = T.StructType(
    [
        T.StructField("observed_at", T.TimestampType(), False),
        T.StructField("arrival_seq", T.LongType(), False),
        T.StructField("tokens", T.ArrayType(T.StringType()), False),
    ]
)

PRIMARY_KEYS = {
    "registry": ["mint"],
    "snapshots": ["mint", "observed_at"],
    "rule_state": ["mint", "rule_key"],
}

TABLES = {"registry": REGISTRY, "snapshots": SNAPSHOTS, "rule_state": RULE_STATE}

# Columns of the current projection, in output order.
TOKEN_FIELDS = (
    "mint",
    "name",
    "symbol",
    "launchpad",
    "tracking_enabled",
    "market_cap",
    "liquidity",
    "holders",
    "trades_5m",
    "traders_5m",
    "buy_volume_5m",
    "sell_volume_5m",
    "volume_5m",
    "age_seconds",
    "poll_age_seconds",
    "change_age_seconds",
    "last_polled_at",
    "last_changed_at",
    "source_updated_at",
    "snapshot_observed_at",
    "disabled_at",
    "disabled_reason",
)

# Numeric fields a change event reports, and the further fields that make two states differ.
DELTA_FIELDS = (
    "market_cap",
    "liquidity",
    "holders",
    "trades_5m",
    "traders_5m",
    "buy_volume_5m",
    "sell_volume_5m",
    "volume_5m",
)
STATE_FIELDS = ("tracking_enabled", "source_updated_at", "last_changed_at")
