"""Operational telemetry: validation, retention, latest state, roll-ups.

Raw events have ``seq`` (arrival order), ``received_at`` and ``body`` (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import (
    ACTIVITY_WINDOW_S,
    RULES,
    TELEMETRY_MAX_BYTES,
    TELEMETRY_MAX_EVENTS,
    TELEMETRY_RETENTION_S,
)
from tidemark.functions.coerce import finite, instant, seconds, string_only
from tidemark.functions.quantile import exact_quantiles

# Required keys per event type, and keys that must not occur anywhere in an event.
REQUIRED_FIELDS = {
    "discovery_tick": (
        "source",
        "status",
        "response_items",
        "candidate_occurrences",
        "unique_candidates",
        "new_mints",
        "latency_ms",
    ),
    "search_lane_tick": ("lane", "status", "requested", "received", "rpm60", "latency_ms"),
    "search_flush": ("polled_tokens", "source_versions", "new_snapshots", "write_ms", "queue_size"),
    "lifecycle_tick": ("apply", "affected_count", "breakdown", "active_remaining", "duration_ms"),
}
FORBIDDEN_KEYS = ("api_key", "apikey", "authorization", "secret")


def has_forbidden_key(body: Column) -> Column:
    """Whether any object in the JSON text, at any depth, has a forbidden key (case ignored).

    The text is brought to canonical form first: there a quote inside a value is always escaped, so only a real key can
    follow an opening brace or comma and precede a colon.
    """
    canonical = F.to_json(F.try_parse_json(body))
    return canonical.rlike(r'[{,]\s*"(?i:' + "|".join(FORBIDDEN_KEYS) + r')"\s*:')


def validate_events(events: DataFrame) -> DataFrame:
    """Events with ``type``, ``at`` and ``valid``. A required key counts when present, even with a null value."""
    parsed = events.withColumn("_v", F.try_parse_json("body"))
    kind, at = string_only(F.col("_v"), "$.type"), string_only(F.col("_v"), "$.at")
    required = F.lit(None).cast("array<string>")
    for name, fields in REQUIRED_FIELDS.items():
        required = F.when(kind == name, F.array(*[F.lit(f) for f in fields])).otherwise(required)
    keys = F.map_keys(F.try_variant_get("_v", "$", "map<string,variant>"))
    complete = F.size(F.array_except(required, keys)) == 0
    valid = required.isNotNull() & (at != "") & complete & ~has_forbidden_key(F.col("body"))
    return parsed.select(
        *events.columns, kind.alias("type"), at.alias("at"), F.coalesce(valid, F.lit(False)).alias("valid")
    )


def validation_counts(validated: DataFrame) -> DataFrame:
    """Received and rejected events."""
    return validated.agg(F.count_if(F.col("valid")).alias("received"), F.count_if(~F.col("valid")).alias("invalid"))


def _bounds(events: DataFrame, now, retention_s: float, max_bytes: int | None) -> tuple[Column, Column]:
    young = F.col("received_at") >= instant(now) - seconds(retention_s)
    fits = F.lit(True)
    if max_bytes is not None and "body" in events.columns:
        fits = F.coalesce(F.octet_length("body") <= max_bytes, F.lit(False))
    return F.coalesce(young, F.lit(False)), fits


def retain_events(
    events: DataFrame,
    now,
    retention_s: float = TELEMETRY_RETENTION_S,
    max_events: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Events inside the retention period (inclusive).

    The contract's bounds (``TELEMETRY_MAX_EVENTS`` newest by receipt, ``TELEMETRY_MAX_BYTES`` of one body) drop rows and
    hold only where they are asked for; ``retention_counts`` says how many rows each of them costs.
    """
    young, fits = _bounds(events, now, retention_s, max_bytes)
    kept = events.where(young & fits)
    if max_events is None:
        return kept
    return kept.orderBy(F.col("received_at").desc(), F.col("seq").desc()).limit(max_events)


def retention_counts(
    events: DataFrame,
    now,
    retention_s: float = TELEMETRY_RETENTION_S,
    max_events: int | None = TELEMETRY_MAX_EVENTS,
    max_bytes: int | None = TELEMETRY_MAX_BYTES,
) -> DataFrame:
    """One row: events, those each bound of ``retain_events`` removes in turn, and those that stay."""
    young, fits = _bounds(events, now, retention_s, max_bytes)
    inside = F.count_if(young & fits)
    beyond = F.lit(0).cast("bigint") if max_events is None else F.greatest(inside - max_events, F.lit(0).cast("bigint"))
    return events.agg(
        F.count("*").alias("events"),
        F.count_if(~young).alias("expired"),
        F.count_if(young & ~fits).alias("oversized"),
        beyond.alias("beyond_limit"),
        (inside - beyond).alias("kept"),
    )


def origin() -> Column:
    """Source or lane of an event; one shared origin for the types that have neither."""
    return (
        F.when(F.col("type") == "discovery_tick", F.col("source"))
        .when(F.col("type") == "search_lane_tick", F.col("lane"))
    )


def latest_events(events: DataFrame) -> DataFrame:
    """Last arrival per type and origin. ``events`` has ``seq, type, source, lane`` and the measures."""
    values = [c for c in events.columns if c != "type"]
    newest = events.where(F.col("type").isin(*REQUIRED_FIELDS)).groupBy("type", origin().alias("origin")).agg(
        F.max_by(F.struct(*values), "seq").alias("_row")
    )
    return newest.select("type", "origin", "_row.*")


def _counted(name: str, kind: str) -> Column:
    """Sum over one event type in which an unknown or non-finite number counts as zero."""
    value = F.coalesce(finite(F.col(name)), F.lit(0.0))
    return F.sum(F.when(F.col("type") == kind, value).otherwise(F.lit(0.0))).alias(name)


def stage_metrics(latest: DataFrame) -> DataFrame:
    """One row of pipeline figures over the latest events; the median latency ignores unknown values."""
    lanes = latest.where(F.col("type") == "search_lane_tick")
    median = exact_quantiles(lanes, "latency_ms", {"median": 0.5}).scalar()
    return latest.agg(
        _counted("response_items", "discovery_tick"),
        _counted("new_mints", "discovery_tick"),
        F.count_if(F.col("type") == "search_lane_tick").alias("lanes"),
        _counted("rpm60", "search_lane_tick"),
        _counted("polled_tokens", "search_flush"),
        _counted("source_versions", "search_flush"),
        _counted("new_snapshots", "search_flush"),
        _counted("affected_count", "lifecycle_tick"),
    ).withColumn("median_latency_ms", median)


RPM_SLICE_S = 600


def rpm60(events: DataFrame, window_s: float = ACTIVITY_WINDOW_S, slice_s: int = RPM_SLICE_S) -> DataFrame:
    """Requests per lane in the trailing window, the row itself included; ``events`` has ``lane`` and ``at TIMESTAMP``.

    A busy lane is cut into time slices; rows near the end of a slice are also handed to the next one as look-back.
    """
    width, reach = slice_s * 1_000_000, int(window_s * 1_000_000)
    if reach > width:
        raise ValueError("the slice must be at least as long as the window")
    at = F.unix_micros("at")
    home = F.floor(at / F.lit(width))
    slices = F.when(at >= (home + 1) * width - reach, F.array(home, home + 1)).otherwise(F.array(home))
    spread = events.withColumns({"_at": at, "_home": home}).withColumn("_slice", F.explode(slices))
    trailing = Window.partitionBy("lane", "_slice").orderBy("_at").rangeBetween(-reach, 0)
    return (
        spread.withColumn("rpm60", F.count("*").over(trailing))
        .where("_slice = _home")
        .drop("_at", "_home", "_slice")
    )


def dedupe_events(events: DataFrame) -> DataFrame:
    """First arrival per type, origin and instant text."""
    values = [c for c in events.columns if c not in ("type", "at")]
    first = events.groupBy("type", origin().alias("_origin"), "at").agg(
        F.min_by(F.struct(*values), "seq").alias("_row")
    )
    return first.select("type", "at", "_row.*")


def tick_series(summaries: DataFrame) -> DataFrame:
    """One row per lifecycle cycle from its ``as_of, rule, affected, active_remaining`` rows."""
    per_rule = [F.sum(F.when(F.col("rule") == rule, F.col("affected"))).alias(rule) for rule in RULES]
    return summaries.groupBy("as_of").agg(
        *per_rule, F.sum("affected").alias("affected_count"), F.max("active_remaining").alias("active_remaining")
    )
