"""The seven retirement rules over evidence rows, first match, and the registry change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import config
from tidemark.config import RULES, RuleConfig
from tidemark.functions.coerce import instant, seconds_between, whole
from tidemark.operators import evidence as ev

DEFAULT = RuleConfig()


def _polled_recently(cfg: RuleConfig) -> Column:
    return seconds_between(F.col("as_of"), F.col("last_polled_at")) <= cfg.poll_lag_s


def _below(value: Column, floor: float) -> Column:
    """False, not NULL, for a missing value."""
    return F.coalesce(value < F.lit(floor), F.lit(False))


def _reaches(value: Column, floor: float) -> Column:
    """NaN reaches nothing, although Spark orders it above every number."""
    return (value >= F.lit(floor)) & ~F.isnan(value)


def rule1(cfg: RuleConfig = DEFAULT) -> Column:
    """Weak current state after the observation period, polled recently."""
    low_liquidity = _below(F.col("latest_liquidity"), cfg.liquidity_floor)
    low_rest = _below(F.col("latest_mcap"), cfg.mcap_floor) & _below(whole(F.col("latest_holders")), cfg.holder_floor)
    reason = (
        F.when(low_liquidity & low_rest, config.REASON_RULE1_BOTH)
        .when(low_liquidity, config.REASON_RULE1_LIQUIDITY)
        .when(low_rest, config.REASON_RULE1_MCAP_HOLDERS)
    )
    return F.when(ev.latest_eligible(cfg) & _polled_recently(cfg), reason)


def rule2(cfg: RuleConfig = DEFAULT) -> Column:
    """Known but not established at the checkpoint, with too few changes."""
    mcap, liquidity = F.col("checkpoint_mcap"), F.col("checkpoint_liquidity")
    established = _reaches(mcap, cfg.established_mcap) & _reaches(liquidity, cfg.established_liquidity)
    few = F.col("changes_in_window") <= cfg.max_changes
    known = mcap.isNotNull() & liquidity.isNotNull()
    return F.when(ev.continuation_eligible(cfg) & known & ~established & few, config.REASON_RULE2)


def rule3(cfg: RuleConfig = DEFAULT) -> Column:
    """No economic data at all by the presence checkpoint."""
    return F.when(ev.presence_eligible(cfg) & ~F.col("has_economic"), config.REASON_RULE3)


def rule4(cfg: RuleConfig = DEFAULT) -> Column:
    return F.when(ev.scan_eligible("rule4", cfg) & F.col("rule4_crossing").isNotNull(), config.REASON_RULE4)


def rule5(cfg: RuleConfig = DEFAULT) -> Column:
    return F.when(ev.scan_eligible("rule5", cfg) & F.col("rule5_crossing").isNotNull(), config.REASON_RULE5)


def rule6(cfg: RuleConfig = DEFAULT) -> Column:
    """Hardly any holders at the holder checkpoint."""
    few = whole(F.col("checkpoint_holders")) < cfg.early_holder_floor
    return F.when(ev.holder_eligible(cfg) & few, config.REASON_RULE6)


def rule7(cfg: RuleConfig = DEFAULT) -> Column:
    """Polled recently, but unchanged for the inactivity period."""
    unchanged = seconds_between(F.col("as_of"), F.col("last_changed_at")) >= cfg.inactivity_s
    return F.when(F.col("first_observed_at").isNotNull() & _polled_recently(cfg) & unchanged, config.REASON_RULE7)


RULE_COLUMNS = dict(zip(RULES, (rule1, rule2, rule3, rule4, rule5, rule6, rule7)))


def rule_candidates(evidence: DataFrame, rule: str, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Keys one rule alone would retire."""
    return evidence.select("mint", F.lit(rule).alias("rule"), RULE_COLUMNS[rule](cfg).alias("reason")).where(
        "reason IS NOT NULL"
    )


def outcome(evidence: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """One row per active key: the first rule in contract order that applies, with its reason (NULL: the key stays), and
    the scans that ended without a crossing and that no earlier rule made idle."""
    hits = [
        F.when(rule(cfg).isNotNull(), F.struct(F.lit(name).alias("rule"), rule(cfg).alias("reason")))
        for name, rule in RULE_COLUMNS.items()
    ]
    scans = F.array(
        *[
            F.when(
                ev.scan_eligible(rule, cfg) & F.col(f"{rule}_crossing").isNull(),
                F.struct(F.lit(rule).alias("rule_key"), F.col(f"{rule}_scanned").alias("scanned_through")),
            )
            for rule in ev.SCANS
        ]
    )
    found = evidence.select("mint", F.coalesce(*hits).alias("hit"), F.array_compact(scans).alias("scans"))
    # Rule names sort in contract order.
    open_scans = F.filter("scans", lambda s: F.col("hit").isNull() | (F.col("hit.rule") > s["rule_key"]))
    return found.select("mint", "hit.rule", "hit.reason", open_scans.alias("clean"))


def candidates(outcome: DataFrame) -> DataFrame:
    return outcome.where("rule IS NOT NULL").select("mint", "rule", "reason")


def first_match(evidence: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """At most one row per key: the first rule in contract order that applies, with its reason."""
    return candidates(outcome(evidence, cfg))


def apply_retirement(registry: DataFrame, candidates: DataFrame, as_of) -> DataFrame:
    """Registry after retiring the candidates; rows retired earlier keep their instant and reason."""
    reasons = candidates.select("mint", F.col("reason").alias("_reason"))
    retire = F.col("tracking_enabled") & F.col("_reason").isNotNull()
    changed = {
        "tracking_enabled": F.col("tracking_enabled") & ~retire,
        "disabled_at": F.when(retire, instant(as_of)).otherwise(F.col("disabled_at")),
        "disabled_reason": F.when(retire, F.col("_reason")).otherwise(F.col("disabled_reason")),
    }
    return registry.join(reasons, "mint", "left").select(
        *[changed.get(name, F.col(name)).alias(name) for name in registry.columns]
    )


def retired_keys(registry: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that are still active, i.e. the keys ``apply_retirement`` changes."""
    return candidates.join(registry.where("tracking_enabled").select("mint"), "mint", "left_semi")


def clean_scans(outcome: DataFrame) -> DataFrame:
    """Scans without a crossing whose key no earlier rule of the same cycle retired."""
    return outcome.select("mint", F.explode("clean").alias("scan")).select("mint", "scan.rule_key", "scan.scanned_through")


def rule_dimension(spark) -> DataFrame:
    return spark.range(1, len(RULES) + 1).select(F.concat(F.lit("rule"), F.col("id").cast("string")).alias("rule"))


def cycle_summary(outcome: DataFrame, applied: bool = True) -> DataFrame:
    """One row per rule, zeros included, with the total and the keys that are active afterwards; one pass over the outcome."""
    staying = F.coalesce("rule", F.lit(""))
    counts = outcome.groupBy(staying.alias("rule")).agg(F.count("*").alias("n"))
    figures = counts.agg(F.map_from_entries(F.collect_list(F.struct("rule", "n"))).alias("by_rule"))
    each = F.explode(F.array(*[F.lit(rule) for rule in RULES])).alias("rule")
    zero = F.lit(0).cast("bigint")
    total = F.aggregate(F.map_values("by_rule"), zero, lambda a, b: a + b)
    stays = F.coalesce(F.col("by_rule")[""], zero)
    return figures.select("by_rule", each).select(
        "rule",
        F.coalesce(F.col("by_rule")[F.col("rule")], zero).alias("affected"),
        (total - stays).alias("total"),
        (stays if applied else total).alias("active_remaining"),
    )


def candidate_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(rule, mint, reason)`` rows only one side has. Empty means both sides agree."""
    columns = ["rule", "mint", "reason"]
    tagged = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return (
        tagged.groupBy(*columns)
        .agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
        .where("_l <> _r")
        .select(*columns, F.when(F.col("_l") == 1, "only_left").otherwise("only_right").alias("side"))
    )


def diff_verdict(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per rule: rows on one side only, and whether the sides agree."""
    counts = candidate_diff(left, right).groupBy("rule").agg(
        F.count_if(F.col("side") == "only_left").alias("only_left"),
        F.count_if(F.col("side") == "only_right").alias("only_right"),
    )
    return (
        rule_dimension(left.sparkSession)
        .join(counts, "rule", "left")
        .select(
            "rule",
            F.coalesce("only_left", F.lit(0)).alias("only_left"),
            F.coalesce("only_right", F.lit(0)).alias("only_right"),
            F.coalesce(F.col("only_left") + F.col("only_right") == 0, F.lit(True)).alias("agrees"),
        )
    )
