"""Rolling activity over change events ``seq, ts, type, mint, token, changes``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import ACTIVITY_WINDOW_S
from tidemark.functions.coerce import finite, instant, seconds
from tidemark.operators.feed import UPDATED


def _recent(now, window_s: float) -> Column:
    return F.col("ts") >= instant(now) - seconds(window_s)


def changed_count(events: DataFrame, now, window_s: float = ACTIVITY_WINDOW_S) -> DataFrame:
    """Distinct keys with any event in the window; the bound is inclusive."""
    return events.where(_recent(now, window_s)).agg(F.count_distinct("mint").alias("changed"))


def volume_signals(events: DataFrame) -> DataFrame:
    """Updates in which volume and volume per market cap both rise, with the values before and after."""
    after_volume, after_mcap = finite(F.col("token.volume_5m")), finite(F.col("token.market_cap"))
    rows = events.where(F.col("type") == UPDATED).select(
        "seq",
        "ts",
        "mint",
        (after_volume - finite(F.col("changes")["volume_5m"]["absolute"])).alias("volume_before"),
        after_volume.alias("volume_after"),
        (after_mcap - finite(F.col("changes")["market_cap"]["absolute"])).alias("mcap_before"),
        after_mcap.alias("mcap_after"),
    )
    rows = rows.where("volume_before >= 0 AND mcap_before > 0 AND mcap_after > 0")
    rows = rows.withColumns(
        {
            "ratio_before": F.try_divide("volume_before", "mcap_before"),
            "ratio_after": F.try_divide("volume_after", "mcap_after"),
        }
    )
    return rows.where("volume_after > volume_before AND ratio_after > ratio_before")


def top_volume_activity(events: DataFrame, now, window_s: float = ACTIVITY_WINDOW_S, limit: int = 5) -> DataFrame:
    """Keys whose volume per market cap rose most over the window, from earliest before to latest after."""
    order = F.struct("ts", "seq")
    folded = (
        volume_signals(events)
        .where(_recent(now, window_s))
        .groupBy("mint")
        .agg(
            F.max("ts").alias("ts"),
            F.min_by(F.struct("volume_before", "mcap_before", "ratio_before"), order).alias("b"),
            F.max_by(F.struct("volume_after", "mcap_after", "ratio_after"), order).alias("a"),
        )
        .select("mint", "ts", "b.*", "a.*")
        .withColumn("volume_change", F.col("volume_after") - F.col("volume_before"))
        .withColumn("ratio_change", F.col("ratio_after") - F.col("ratio_before"))
        .where("volume_change > 0 AND ratio_change > 0")
    )
    ranking = [F.col("ratio_change").desc(), F.col("volume_change").desc(), F.col("mint").asc()]
    top = folded.orderBy(*ranking).limit(max(limit, 0))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*ranking)))
