"""Evidence of the retirement rules.

All rules look at the same history from different reference instants. One join with the active registry and one
aggregate per key gather everything: latest state, two as-of states, one change count, one presence flag and two
incremental threshold scans. Every aggregate is a scalar fold, so it combines map-side and a hot key costs no more than
its rows; the single-rule functions are projections of the same plan and Catalyst drops what they do not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.config import RuleConfig
from tidemark.functions.coerce import instant, seconds
from tidemark.functions.joins import split_ready

DEFAULT = RuleConfig()
SCANS = {"rule4": ("scan_liquidity", "collapse_liquidity"), "rule5": ("scan_mcap", "collapse_mcap")}


def source_state(registry: DataFrame) -> DataFrame:
    """Collector instants of the active keys."""
    return registry.where("tracking_enabled").select(
        "mint", "first_observed_at", "last_polled_at", "last_changed_at", "source_updated_at"
    )


def _scan_start(created: Column, cursor: Column, cfg: RuleConfig) -> Column:
    """Exclusive lower bound of a scan: the cursor, else one microsecond before the grace period ends."""
    return F.coalesce(cursor, created + seconds(cfg.collapse_grace_s) - F.expr("INTERVAL '0.000001' SECOND"))


def _with_cursors(active: DataFrame, cursors: DataFrame | None) -> DataFrame:
    if cursors is None:
        return active.withColumns({f"{rule}_cursor": F.lit(None).cast("timestamp") for rule in SCANS})
    wide = cursors.groupBy("mint").agg(
        *[F.max(F.when(F.col("rule_key") == rule, F.col("scanned_through"))).alias(f"{rule}_cursor") for rule in SCANS]
    )
    return active.join(wide, "mint", "left")


def evidence(
    registry: DataFrame,
    measures: DataFrame,
    as_of,
    cfg: RuleConfig = DEFAULT,
    cursors: DataFrame | None = None,
) -> DataFrame:
    """One row per active key, also for keys without history. ``measures`` is a ``lifecycle_view``."""
    now = instant(as_of)
    active = registry.where("tracking_enabled").select(
        "mint", "created_at", "first_observed_at", "last_polled_at", "last_changed_at"
    )
    at = F.col("observed_at")
    created, first = F.col("created_at"), F.col("first_observed_at")

    checkpoint_at = F.when(at <= created + seconds(cfg.continuation_checkpoint_s), at)
    holder_at = F.when(at <= first + seconds(cfg.holder_checkpoint_s), at)
    in_signal = (at > created + seconds(cfg.observation_s)) & (at <= created + seconds(cfg.continuation_checkpoint_s))

    folds = [
        F.max(at).alias("latest_at"),
        F.max_by("mcap", at).alias("latest_mcap"),
        F.max_by("liquidity", at).alias("latest_liquidity"),
        F.max_by("holders", at).alias("latest_holders"),
        F.max(checkpoint_at).alias("checkpoint_at"),
        F.max_by("mcap", checkpoint_at).alias("checkpoint_mcap"),
        F.max_by("liquidity", checkpoint_at).alias("checkpoint_liquidity"),
        F.count_if(in_signal).alias("changes_in_window"),
        F.max(F.col("has_economic") & (at <= now)).alias("has_economic"),
        F.max(holder_at).alias("holder_at"),
        F.max_by("holders", holder_at).alias("checkpoint_holders"),
    ]
    for rule, (field, floor) in SCANS.items():
        unseen = at > _scan_start(created, F.col(f"{rule}_cursor"), cfg)
        below = F.col(field) < F.lit(getattr(cfg, floor))
        folds.append(F.max(F.when(unseen, at)).alias(f"{rule}_scanned"))
        folds.append(F.min(F.when(unseen & below, at)).alias(f"{rule}_crossing"))

    marks = _with_cursors(active, cursors).drop("last_polled_at", "last_changed_at")
    joined = measures.join(split_ready(marks, "mint"), "mint")
    folded = joined.groupBy("mint").agg(*folds)
    result = active.join(folded, "mint", "left")
    return result.withColumns(
        {
            "has_economic": F.coalesce("has_economic", F.lit(False)),
            "changes_in_window": F.coalesce("changes_in_window", F.lit(0)),
            "as_of": now,
        }
    )


def mature(ev_first: Column, now: Column, cfg: RuleConfig) -> Column:
    return ev_first <= now - seconds(cfg.observation_s)


def in_slot(created: Column, now: Column, checkpoint_s: float, grace_s: float) -> Column:
    """Created so that the checkpoint lies in the grace slot ending at ``now``."""
    return (created > now - seconds(checkpoint_s + grace_s)) & (created <= now - seconds(checkpoint_s))


def continuation_eligible(cfg: RuleConfig) -> Column:
    created = F.col("created_at")
    checkpoint = created + seconds(cfg.continuation_checkpoint_s)
    return (
        in_slot(created, F.col("as_of"), cfg.continuation_checkpoint_s, cfg.continuation_grace_s)
        & (F.col("first_observed_at") <= created + seconds(cfg.observation_s))
        & (F.col("last_polled_at") >= checkpoint)
        & F.col("checkpoint_at").isNotNull()
    )


def presence_eligible(cfg: RuleConfig) -> Column:
    created = F.col("created_at")
    checkpoint = created + seconds(cfg.presence_checkpoint_s)
    return (
        in_slot(created, F.col("as_of"), cfg.presence_checkpoint_s, cfg.presence_grace_s)
        & (F.col("first_observed_at") <= checkpoint)
        & (F.col("last_polled_at") >= checkpoint)
    )


def scan_eligible(rule: str, cfg: RuleConfig) -> Column:
    return (F.col("created_at") <= F.col("as_of") - seconds(cfg.collapse_grace_s)) & F.col(f"{rule}_scanned").isNotNull()


def holder_eligible(cfg: RuleConfig) -> Column:
    first = F.col("first_observed_at")
    checkpoint = first + seconds(cfg.holder_checkpoint_s)
    return (
        (first <= F.col("as_of") - seconds(cfg.holder_checkpoint_s))
        & (F.col("last_polled_at") >= checkpoint)
        & F.col("holder_at").isNotNull()
    )


def latest_eligible(cfg: RuleConfig) -> Column:
    return mature(F.col("first_observed_at"), F.col("as_of"), cfg) & F.col("latest_at").isNotNull()


def latest_state(registry: DataFrame, measures: DataFrame, as_of, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Newest state of the active keys observed long enough; keys without history are absent."""
    return evidence(registry, measures, as_of, cfg).where(latest_eligible(cfg)).select(
        "mint", "last_polled_at", "latest_at", "latest_mcap", "latest_liquidity", "latest_holders"
    )


def continuation_checkpoint(registry: DataFrame, measures: DataFrame, as_of, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """State as of the checkpoint and number of versions after the observation period; inside the slot only."""
    return evidence(registry, measures, as_of, cfg).where(continuation_eligible(cfg)).select(
        "mint", "checkpoint_at", "checkpoint_mcap", "checkpoint_liquidity", "changes_in_window"
    )


def economic_presence(registry: DataFrame, measures: DataFrame, as_of, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Whether any snapshot up to ``as_of`` had economic text; False also for keys without history."""
    return evidence(registry, measures, as_of, cfg).where(presence_eligible(cfg)).select("mint", "has_economic")


def holder_checkpoint(registry: DataFrame, measures: DataFrame, as_of, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Holder count as of the checkpoint after first observation; never expires."""
    return evidence(registry, measures, as_of, cfg).where(holder_eligible(cfg)).select(
        "mint", "holder_at", "checkpoint_holders"
    )


def threshold_scan(
    registry: DataFrame,
    measures: DataFrame,
    cursors: DataFrame | None,
    rule: str,
    as_of,
    cfg: RuleConfig = DEFAULT,
) -> DataFrame:
    """Newest unseen instant and first crossing per key; keys with nothing unseen are absent."""
    return evidence(registry, measures, as_of, cfg, cursors).where(scan_eligible(rule, cfg)).select(
        "mint",
        F.lit(rule).alias("rule_key"),
        F.col(f"{rule}_scanned").alias("scanned_through"),
        F.col(f"{rule}_crossing").alias("crossing_at"),
    )


def advance_cursor(cursors: DataFrame, clean: DataFrame) -> DataFrame:
    """Cursors after moving the cleanly scanned keys forward; never backward.

    ``clean`` has ``mint, rule_key, scanned_through``, one row per active key and rule.
    """
    moved = clean.select("mint", "rule_key", F.col("scanned_through").alias("_moved"))
    return cursors.join(moved, ["mint", "rule_key"], "full_outer").select(
        "mint", "rule_key", F.greatest("scanned_through", "_moved").alias("scanned_through")
    )
