"""Contract constants, kept as defaults of one frozen dataclass.

Durations are seconds. ``scaled`` stretches the minute-grained contract durations so that the same rules can run
over data with another time grain; poll lag and the inactivity period stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Rule order and the reason texts each rule may emit.
RULES = ("rule1", "rule2", "rule3", "rule4", "rule5", "rule6", "rule7")
REASON_RULE1_BOTH = "liquidity_below_1000_and_mcap_below_3000_and_holders_below_300"
REASON_RULE1_LIQUIDITY = "liquidity_below_1000"
REASON_RULE1_MCAP_HOLDERS = "mcap_below_3000_and_holders_below_300"
REASON_RULE2 = "early_continuation_failure"
REASON_RULE3 = "economic_data_missing_at_5m"
REASON_RULE4 = "liquidity_collapse_below_2000"
REASON_RULE5 = "mcap_collapse_below_2000"
REASON_RULE6 = "holder_count_below_5_at_30m"
REASON_RULE7 = "source_unchanged_for_24h"


@dataclass(frozen=True)
class RuleConfig:
    # Thresholds and durations of the seven retirement rules.
    observation_s: float = 600.0
    poll_lag_s: float = 60.0
    liquidity_floor: float = 1_000.0
    mcap_floor: float = 3_000.0
    holder_floor: int = 300
    continuation_checkpoint_s: float = 1_800.0
    continuation_grace_s: float = 60.0
    max_changes: int = 10
    established_mcap: float = 50_000.0
    established_liquidity: float = 5_000.0
    presence_checkpoint_s: float = 300.0
    presence_grace_s: float = 60.0
    collapse_grace_s: float = 1_800.0
    collapse_liquidity: float = 2_000.0
    collapse_mcap: float = 2_000.0
    holder_checkpoint_s: float = 1_800.0
    early_holder_floor: int = 5
    inactivity_s: float = 86_400.0

    def scaled(self, factor: float, **changes) -> "RuleConfig":
        stretched = {
            name: getattr(self, name) * factor
            for name in (
                "observation_s",
                "continuation_checkpoint_s",
                "continuation_grace_s",
                "presence_checkpoint_s",
                "presence_grace_s",
                "collapse_grace_s",
                "holder_checkpoint_s",
            )
        }
        return replace(self, **{**stretched, **changes})


# Retention, sampling and window lengths of the remaining operators (seconds unless noted).
RETENTION_HOURS = 24
SAMPLE_SECONDS = 300
ACTIVITY_WINDOW_S = 60
TELEMETRY_RETENTION_S = 600
TELEMETRY_MAX_EVENTS = 50_000
TELEMETRY_MAX_BYTES = 60_000
PULSE_INTERVAL_S = 1
PULSE_RETENTION_S = 6 * 60 * 60
RANK_DEFAULT_LIMIT = 5
RANK_MAX_LIMIT = 20
SEARCH_LIMIT = 8
