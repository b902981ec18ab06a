"""Cross-section of a population: volume, pressure and liquidity, for all keys or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import PULSE_INTERVAL_S, PULSE_RETENTION_S
from tidemark.functions.coerce import finite, percent, seconds
from tidemark.functions.quantile import exact_quantiles
from tidemark.operators.sampling import spaced

TOP = 10
COLUMNS = (
    "active_count",
    "volume_total",
    "volume_known",
    "volume_coverage_pct",
    "volume_breadth_pct",
    "volume_top10_share_pct",
    "buy_volume",
    "sell_volume",
    "net_volume",
    "buy_share_pct",
    "pressure_known",
    "pressure_coverage_pct",
    "liquidity_total",
    "liquidity_median",
    "liquidity_known",
    "liquidity_coverage_pct",
)


def _active(tokens: DataFrame, by: Sequence[str]) -> DataFrame:
    """Active keys with the finite measures only; anything else is unknown, never zero."""
    buy, sell = finite(F.col("buy_volume_5m")), finite(F.col("sell_volume_5m"))
    both = buy.isNotNull() & sell.isNotNull()
    return tokens.where("tracking_enabled").select(
        *by,
        finite(F.col("volume_5m")).alias("volume"),
        F.when(both, buy).alias("buy"),
        F.when(both, sell).alias("sell"),
        finite(F.col("liquidity")).alias("liquidity"),
    )


def _top_sum(active: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of the largest volumes per group; each task passes on at most ``TOP`` rows per group."""
    known = active.where("volume IS NOT NULL").select(*by, "volume")
    if by:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("volume").desc()))
        known = known.withColumn("_rank", rank).where(F.col("_rank") <= TOP)
        return known.groupBy(*by).agg(F.sum("volume").alias("top_volume"))
    return known.orderBy(F.col("volume").desc()).limit(TOP).agg(F.sum("volume").alias("top_volume"))


def _pulse_columns(top_volume: Column, median: Column) -> dict[str, Column]:
    c = F.col
    hundred = F.lit(100.0)
    total = c("active_count")
    paired = c("buy_volume") + c("sell_volume")
    return {
        "volume_coverage_pct": percent(c("volume_known"), total),
        "volume_breadth_pct": percent(c("volume_rising"), c("volume_known")),
        "volume_top10_share_pct": F.when(c("volume_total") > 0, top_volume / c("volume_total") * hundred),
        "net_volume": c("buy_volume") - c("sell_volume"),
        "buy_share_pct": percent(c("buy_volume"), paired),
        "pressure_coverage_pct": percent(c("pressure_known"), total),
        "liquidity_median": median,
        "liquidity_coverage_pct": percent(c("liquidity_known"), total),
    }


def market_pulse(tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for the population, or one per group with at least one active key; NULL is a group like any other."""
    by = list(by)
    active = _active(tokens, by)
    base = [
        F.count("*").alias("active_count"),
        F.sum("volume").alias("volume_total"),
        F.count("volume").alias("volume_known"),
        F.count_if(F.col("volume") > 0).alias("volume_rising"),
        F.sum("buy").alias("buy_volume"),
        F.sum("sell").alias("sell_volume"),
        F.count("buy").alias("pressure_known"),
        F.sum("liquidity").alias("liquidity_total"),
        F.count("liquidity").alias("liquidity_known"),
    ]
    medians = exact_quantiles(active, "liquidity", {"median": 0.5}, by)
    top = _top_sum(active, by)
    if by:
        joined = active.groupBy(*by).agg(*base)
        for side in (medians, top):
            side = side.withColumnsRenamed({c: f"_of_{c}" for c in by})
            joined = joined.join(side, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], "left").drop(*(f"_of_{c}" for c in by))
        derived = _pulse_columns(F.col("top_volume"), F.col("median"))
    else:
        joined = active.agg(*base)
        derived = _pulse_columns(top.scalar(), medians.scalar())
    return joined.withColumns(derived).select(*by, *COLUMNS)


def pulse_struct(pulse: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nested form of ``market_pulse``."""
    c = F.col
    return pulse.select(
        *by,
        "active_count",
        F.struct(
            c("volume_total").alias("total"),
            c("volume_known").alias("known_tokens"),
            c("volume_coverage_pct").alias("coverage_pct"),
            c("volume_breadth_pct").alias("breadth_pct"),
            c("volume_top10_share_pct").alias("top10_share_pct"),
        ).alias("volume_5m"),
        F.struct(
            "buy_volume",
            "sell_volume",
            "net_volume",
            "buy_share_pct",
            c("pressure_known").alias("known_tokens"),
            c("pressure_coverage_pct").alias("coverage_pct"),
        ).alias("pressure_5m"),
        F.struct(
            c("liquidity_total").alias("total"),
            c("liquidity_median").alias("median"),
            c("liquidity_known").alias("known_tokens"),
            c("liquidity_coverage_pct").alias("coverage_pct"),
        ).alias("liquidity"),
    )


def pulse_series(
    populations: DataFrame,
    every_s: float = PULSE_INTERVAL_S,
    keep_s: float = PULSE_RETENTION_S,
) -> DataFrame:
    """Pulse per sampled instant of ``ts`` + token rows: the first instant of every interval, newest ``keep_s`` kept.

    Sampling by fixed intervals is the form that needs no pass over the series in order; ``spaced_pulse_series`` keeps the exact
    minimum gap.
    """
    step = int(every_s * 1_000_000)
    sampled = populations.groupBy(F.floor(F.unix_micros("ts") / F.lit(step)).alias("_slot")).agg(F.min("ts").alias("ts"))
    newest = sampled.agg(F.max("ts").alias("ts")).scalar()
    kept = sampled.where(F.col("ts") >= newest - seconds(keep_s)).select("ts")
    return market_pulse(populations.join(kept, "ts", "left_semi"), by=["ts"])


def spaced_pulse_series(
    populations: DataFrame,
    every_s: float = PULSE_INTERVAL_S,
    keep_s: float = PULSE_RETENTION_S,
) -> DataFrame:
    """Pulse per kept instant: the first, then always the first one at least ``every_s`` later; newest ``keep_s`` kept."""
    kept = spaced(populations.select("ts"), every_s)
    newest = kept.agg(F.max("ts").alias("ts")).scalar()
    kept = kept.where(F.col("ts") >= newest - seconds(keep_s))
    return market_pulse(populations.join(kept, "ts", "left_semi"), by=["ts"])
