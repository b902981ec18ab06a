"""Current projection: newest snapshot per key next to the registry row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark import schemas
from tidemark.functions.coerce import instant, seconds_between

VIEW_FIELDS = (
    "name",
    "symbol",
    "launchpad",
    "market_cap",
    "liquidity",
    "holders",
    "trades_5m",
    "traders_5m",
    "buy_volume_5m",
    "sell_volume_5m",
    "volume_5m",
)


def visible(registry: DataFrame, as_of, recent_minutes: float | None = None) -> DataFrame:
    """Active keys, and with ``recent_minutes`` also those retired at most that long ago (inclusive)."""
    shown = F.col("tracking_enabled")
    if recent_minutes is not None:
        since = instant(as_of) - F.expr(f"make_dt_interval(0, 0, 0, {recent_minutes * 60:.6f})")
        shown = shown | F.coalesce(F.col("disabled_at") >= since, F.lit(False))
    return registry.where(shown)


def latest_view(current: DataFrame) -> DataFrame:
    """Newest row of a ``current_view`` per key. The partial aggregate leaves one row per key and task to shuffle."""
    newest = current.groupBy("mint").agg(
        F.max_by(F.struct("observed_at", *VIEW_FIELDS), "observed_at").alias("_row")
    )
    return newest.select("mint", "_row.*")


def current_projection(registry: DataFrame, current: DataFrame, as_of, recent_minutes: float | None = None) -> DataFrame:
    """One row per visible key that has at least one snapshot."""
    return project_newest(registry, latest_view(current), as_of, recent_minutes)


def project_newest(registry: DataFrame, newest: DataFrame, as_of, recent_minutes: float | None = None) -> DataFrame:
    """The projection from a state with the newest row per key (``latest_view``, or a table that ``sources.newest`` keeps)."""
    now = instant(as_of)
    facts = visible(registry, as_of, recent_minutes).withColumnsRenamed({"name": "_name", "symbol": "_symbol"})
    joined = newest.join(facts, "mint")
    since = F.coalesce("first_pool_created_at", "created_at", "first_observed_at", "observed_at")
    derived = {
        "name": F.coalesce("name", "_name", F.lit("")),
        "symbol": F.coalesce("symbol", "_symbol", F.lit("")),
        "launchpad": F.coalesce("launchpad", F.lit("unknown")),
        "age_seconds": seconds_between(now, since),
        "poll_age_seconds": seconds_between(now, F.col("last_polled_at")),
        "change_age_seconds": seconds_between(now, F.col("last_changed_at")),
        "snapshot_observed_at": F.col("observed_at"),
    }
    return joined.select(*[derived.get(name, F.col(name)).alias(name) for name in schemas.TOKEN_FIELDS])


def lookup(registry: DataFrame, current: DataFrame, key: str, as_of, recent_minutes: float) -> DataFrame:
    """One key, also when retired recently. The key filter reaches both scans."""
    return current_projection(
        registry.where(F.col("mint") == key), current.where(F.col("mint") == key), as_of, recent_minutes
    )


def normalise_row(tokens: DataFrame) -> DataFrame:
    """Output form: fixed types, texts never NULL, instants as UTC ISO text."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    instants = ("last_polled_at", "last_changed_at", "snapshot_observed_at", "disabled_at")
    columns = []
    for name in schemas.TOKEN_FIELDS:
        column = F.col(name)
        if name in instants:
            column = F.date_format(column, iso)
            column = F.regexp_replace(F.regexp_replace(column, "Z$", "+00:00"), r"\.000000(?=\+)", "")
        elif name in ("name", "symbol"):
            column = F.coalesce(column, F.lit(""))
        elif name == "launchpad":
            column = F.when(column != "", column).otherwise("unknown")
        elif name == "tracking_enabled":
            column = F.coalesce(column, F.lit(False))
        columns.append(column.alias(name))
    return tokens.select(*columns)
