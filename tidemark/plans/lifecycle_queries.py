"""Registered queries: evidence, rules and the lifecycle cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import RULES
from tidemark.operators import evidence as ev, evidence_state as es, lifecycle as lc
from tidemark.operators.telemetry import tick_series
from tidemark.plans import fixtures as fx
from tidemark.plans.common import CFG, tidy
from tidemark.plans.cycle import lifecycle_cycle

NOW = fx.FULL
T = f"TIMESTAMP '{NOW}'"

LATEST_WHERE = f"r.tracking_enabled AND r.first_observed_at <= {T} - INTERVAL '10' HOUR"
SLOT2 = f"""r.tracking_enabled AND r.created_at > {T} - INTERVAL '31' HOUR AND r.created_at <= {T} - INTERVAL '30' HOUR
    AND r.first_observed_at <= r.created_at + INTERVAL '10' HOUR AND r.last_polled_at >= r.created_at + INTERVAL '30' HOUR"""
SLOT3 = f"""r.tracking_enabled AND r.created_at > {T} - INTERVAL '6' HOUR AND r.created_at <= {T} - INTERVAL '5' HOUR
    AND r.first_observed_at <= r.created_at + INTERVAL '5' HOUR AND r.last_polled_at >= r.created_at + INTERVAL '5' HOUR"""
HOLDER_WHERE = f"""r.tracking_enabled AND r.first_observed_at <= {T} - INTERVAL '30' HOUR
    AND r.last_polled_at >= r.first_observed_at + INTERVAL '30' HOUR"""

EXTRA = f"""
asof2 AS (SELECT * FROM (SELECT s.mint, s.observed_at, s.mcap, s.liquidity,
        row_number() OVER (PARTITION BY s.mint ORDER BY s.observed_at DESC) AS rn
    FROM snaps s JOIN spread r ON r.mint = s.mint WHERE s.observed_at <= r.created_at + INTERVAL '30' HOUR) WHERE rn = 1),
asof6 AS (SELECT * FROM (SELECT s.mint, s.observed_at, s.holder_count,
        row_number() OVER (PARTITION BY s.mint ORDER BY s.observed_at DESC) AS rn
    FROM snaps s JOIN spread r ON r.mint = s.mint WHERE s.observed_at <= r.first_observed_at + INTERVAL '30' HOUR) WHERE rn = 1),
sig AS (SELECT r.mint, count(s.observed_at) AS n FROM spread r LEFT JOIN snaps s ON s.mint = r.mint
    AND s.observed_at > r.created_at + INTERVAL '10' HOUR AND s.observed_at <= r.created_at + INTERVAL '30' HOUR GROUP BY 1)"""


def _scan_sql(rule: str, column: str, with_cursor: bool) -> str:
    start = "r.created_at + INTERVAL '30' HOUR - INTERVAL '1' MICROSECOND"
    bound = f"coalesce(c.scanned_through, {start})" if with_cursor else start
    join = f"LEFT JOIN cur c ON c.mint = r.mint AND c.rule_key = '{rule}'" if with_cursor else ""
    return f"""SELECT r.mint, '{rule}' AS rule_key, max(s.observed_at) AS scanned_through,
        min(CASE WHEN s.{column} < 2000 THEN s.observed_at END) AS crossing_at
        FROM spread r {join} JOIN snaps s ON s.mint = r.mint AND s.observed_at > {bound}
        WHERE r.tracking_enabled AND r.created_at <= {T} - INTERVAL '30' HOUR GROUP BY r.mint"""


RULE_SQL = {
    "rule1": f"""SELECT r.mint, 'rule1' AS rule, CASE
        WHEN l.liquidity < 1000 AND l.mcap < 3000 AND l.holder_count < 300 THEN 'liquidity_below_1000_and_mcap_below_3000_and_holders_below_300'
        WHEN l.liquidity < 1000 THEN 'liquidity_below_1000' ELSE 'mcap_below_3000_and_holders_below_300' END AS reason
        FROM spread r JOIN latest l ON l.mint = r.mint WHERE {LATEST_WHERE}
        AND epoch_us({T}) - epoch_us(r.last_polled_at) <= 60000000
        AND (l.liquidity < 1000 OR (l.mcap < 3000 AND l.holder_count < 300))""",
    "rule2": f"""SELECT r.mint, 'rule2' AS rule, 'early_continuation_failure' AS reason
        FROM spread r JOIN asof2 a ON a.mint = r.mint JOIN sig ON sig.mint = r.mint WHERE {SLOT2}
        AND a.mcap IS NOT NULL AND a.liquidity IS NOT NULL AND NOT (a.mcap >= 50000 AND a.liquidity >= 5000) AND sig.n <= 2""",
    "rule3": f"""SELECT r.mint, 'rule3' AS rule, 'economic_data_missing_at_5m' AS reason FROM spread r WHERE {SLOT3}
        AND NOT EXISTS (SELECT 1 FROM snaps s WHERE s.mint = r.mint AND (s.mcap IS NOT NULL OR s.liquidity IS NOT NULL))""",
    "rule4": f"SELECT mint, 'rule4' AS rule, 'liquidity_collapse_below_2000' AS reason FROM ({_scan_sql('rule4', 'liquidity', False)}) WHERE crossing_at IS NOT NULL",
    "rule5": f"SELECT mint, 'rule5' AS rule, 'mcap_collapse_below_2000' AS reason FROM ({_scan_sql('rule5', 'mcap', False)}) WHERE crossing_at IS NOT NULL",
    "rule6": f"""SELECT r.mint, 'rule6' AS rule, 'holder_count_below_5_at_30m' AS reason
        FROM spread r JOIN asof6 a ON a.mint = r.mint WHERE {HOLDER_WHERE} AND a.holder_count < 5""",
    "rule7": f"""SELECT r.mint, 'rule7' AS rule, 'source_unchanged_for_24h' AS reason FROM spread r WHERE r.tracking_enabled
        AND epoch_us({T}) - epoch_us(r.last_polled_at) <= 60000000 AND epoch_us({T}) - epoch_us(r.last_changed_at) >= 86400000000""",
}


def _sql(body: str, extra: str = EXTRA) -> str:
    return fx.with_ctes(("spread", "latest", "cur"), body, extra=extra.strip())


ALL_RULES = " UNION ALL ".join(f"({RULE_SQL[r]})" for r in RULES)
FIRST = EXTRA + f",\nhits AS ({ALL_RULES}),\nfirsts AS (SELECT mint, min(rule) AS rule, arg_min(reason, rule) AS reason FROM hits GROUP BY mint)"
CURSOR_SCANS = " UNION ALL ".join(
    f"({_scan_sql(rule, column, True)})" for rule, column in (("rule4", "liquidity"), ("rule5", "mcap"))
)
WITH_CURSOR_RULES = {
    **RULE_SQL,
    "rule4": "SELECT mint, 'rule4' AS rule, 'liquidity_collapse_below_2000' AS reason FROM scans WHERE rule_key = 'rule4' AND crossing_at IS NOT NULL",
    "rule5": "SELECT mint, 'rule5' AS rule, 'mcap_collapse_below_2000' AS reason FROM scans WHERE rule_key = 'rule5' AND crossing_at IS NOT NULL",
}
CURSOR_CYCLE = (
    EXTRA
    + f",\nscans AS ({CURSOR_SCANS}),\nhits AS ("
    + " UNION ALL ".join(f"({WITH_CURSOR_RULES[r]})" for r in RULES)
    + "),\nfirsts AS (SELECT mint, min(rule) AS rule, arg_min(reason, rule) AS reason FROM hits GROUP BY mint)"
)


def inputs(spark, sf):
    return fx.spread_registry(spark, sf, NOW), fx.lifecycle_rows(spark, sf, NOW)


def _evidence(spark, sf, cursors=False):
    return ev.evidence(*inputs(spark, sf), NOW, CFG, fx.cursors(spark, sf) if cursors else None)


def q_latest_state(spark, sf):
    return tidy(ev.latest_state(*inputs(spark, sf), NOW, CFG))


def q_rule2_evidence(spark, sf):
    return tidy(ev.continuation_checkpoint(*inputs(spark, sf), NOW, CFG))


def q_rule3_evidence(spark, sf):
    return tidy(ev.economic_presence(*inputs(spark, sf), NOW, CFG))


def q_rule6_evidence(spark, sf):
    return tidy(ev.holder_checkpoint(*inputs(spark, sf), NOW, CFG))


def q_source_state(spark, sf):
    return tidy(ev.source_state(fx.spread_registry(spark, sf, NOW)).drop("source_updated_at"))


def _scan(rule):
    def run(spark, sf):
        registry, rows = inputs(spark, sf)
        return tidy(ev.threshold_scan(registry, rows, fx.cursors(spark, sf), rule, NOW, CFG))

    return run


def _rule(rule):
    def run(spark, sf):
        return lc.rule_candidates(_evidence(spark, sf), rule, CFG)

    return run


EVIDENCE_COLUMNS = [
    "mint", "latest_at", "checkpoint_at", "changes_in_window", "has_economic", "holder_at", "rule4_scanned",
    "rule4_crossing", "rule5_scanned", "rule5_crossing", "latest_mcap", "latest_liquidity", "latest_holders", "checkpoint_mcap",
    "checkpoint_liquidity", "checkpoint_holders",
]


def q_evidence(spark, sf):
    return tidy(_evidence(spark, sf, cursors=True).select(*EVIDENCE_COLUMNS))


def q_evidence_carried(spark, sf):
    """The same evidence from the state of the older days, late rows that came after it, and the rows of the last days."""
    registry, rows = inputs(spark, sf)
    cursors, closed = fx.cursors(spark, sf), F.col("observed_at") < F.lit(fx.BEFORE).cast("timestamp")
    late = F.pmod(F.xxhash64("mint", "observed_at"), F.lit(10)) == 0
    state = es.fold(registry, rows.where(closed & ~late), CFG, cursors)
    state = es.merge(state, es.fold(registry, rows.where(closed & late), CFG, cursors))
    return tidy(es.carried(registry, state, rows.where(~closed), NOW, CFG, cursors).select(*EVIDENCE_COLUMNS))


def _cycle(spark, sf):
    registry, rows = inputs(spark, sf)
    return lifecycle_cycle(registry, rows, fx.cursors(spark, sf), NOW, CFG)


def q_lifecycle_cycle(spark, sf):
    return lc.first_match(_evidence(spark, sf), CFG)


def q_apply_retirement(spark, sf):
    after = _cycle(spark, sf).registry
    return tidy(after.select("mint", "tracking_enabled", "disabled_at", "disabled_reason"))


def q_advance_cursor(spark, sf):
    return tidy(_cycle(spark, sf).cursors)


def q_cycle_summary(spark, sf):
    return _cycle(spark, sf).summary


def q_candidate_diff(spark, sf):
    found = _evidence(spark, sf)
    strict = lc.first_match(found, CFG)
    loose = lc.first_match(found, CFG.scaled(1, max_changes=10, liquidity_floor=500.0))
    return lc.candidate_diff(strict, loose)


def q_tick_series(spark, sf):
    registry, rows = inputs(spark, sf)
    summaries = []
    for hours in (0, 24):
        as_of = F.lit(NOW).cast("timestamp") + F.expr(f"make_dt_interval(0, {hours})")
        found = lc.outcome(ev.evidence(registry, rows, as_of, CFG), CFG)
        summaries.append(lc.cycle_summary(found).withColumn("as_of", as_of))
    return tidy(tick_series(summaries[0].unionByName(summaries[1])))


EVIDENCE_SQL = """SELECT r.mint, epoch_us(l.observed_at) AS latest_at_us, epoch_us(a.observed_at) AS checkpoint_at_us,
    sig.n AS changes_in_window, coalesce((SELECT bool_or(s.mcap IS NOT NULL OR s.liquidity IS NOT NULL) FROM snaps s WHERE s.mint = r.mint), false) AS has_economic,
    epoch_us(h.observed_at) AS holder_at_us, epoch_us(f.scanned_through) AS rule4_scanned_us, epoch_us(f.crossing_at) AS rule4_crossing_us,
    epoch_us(g.scanned_through) AS rule5_scanned_us, epoch_us(g.crossing_at) AS rule5_crossing_us,
    round(l.mcap, 6) AS latest_mcap, round(l.liquidity, 6) AS latest_liquidity, CAST(l.holder_count AS DOUBLE) AS latest_holders,
    round(a.mcap, 6) AS checkpoint_mcap, round(a.liquidity, 6) AS checkpoint_liquidity, CAST(h.holder_count AS DOUBLE) AS checkpoint_holders
    FROM spread r LEFT JOIN latest l ON l.mint = r.mint LEFT JOIN asof2 a ON a.mint = r.mint LEFT JOIN sig ON sig.mint = r.mint
    LEFT JOIN asof6 h ON h.mint = r.mint LEFT JOIN scan_all f ON f.mint = r.mint AND f.rule_key = 'rule4'
    LEFT JOIN scan_all g ON g.mint = r.mint AND g.rule_key = 'rule5' WHERE r.tracking_enabled"""
# The fused evidence also scans keys that are not yet old enough for the rule.
SCAN_ALL = ",\nscan_all AS (" + CURSOR_SCANS.replace(f"AND r.created_at <= {T} - INTERVAL '30' HOUR", "") + ")"

REGISTRY_AFTER = f"""SELECT r.mint, r.tracking_enabled AND f.mint IS NULL AS tracking_enabled,
    epoch_us(CASE WHEN r.tracking_enabled AND f.mint IS NOT NULL THEN {T}
        WHEN NOT r.tracking_enabled AND r.user_id % 40 <> 0 THEN {T} - INTERVAL '1' MINUTE * (r.user_id % 60) END) AS disabled_at_us,
    CASE WHEN r.tracking_enabled AND f.mint IS NOT NULL THEN f.reason WHEN NOT r.tracking_enabled THEN 'earlier' END AS disabled_reason
    FROM spread r LEFT JOIN firsts f ON f.mint = r.mint"""

LOOSE = {**RULE_SQL, "rule1": RULE_SQL["rule1"].replace("l.liquidity < 1000", "l.liquidity < 500"),
         "rule2": RULE_SQL["rule2"].replace("sig.n <= 2", "sig.n <= 10")}
DIFF = (
    FIRST
    + ",\nhits2 AS (" + " UNION ALL ".join(f"({LOOSE[r]})" for r in RULES) + ")"
    + ",\nfirsts2 AS (SELECT mint, min(rule) AS rule, arg_min(reason, rule) AS reason FROM hits2 GROUP BY mint)"
)

# The second cycle looks at the same registry a day later.
T_NEXT = f"({T} + INTERVAL '24' HOUR)"
TICKS = (
    ",\nhits_next AS (" + " UNION ALL ".join(f"({RULE_SQL[r].replace(T, T_NEXT)})" for r in RULES) + ")"
    + ",\nfirsts_next AS (SELECT mint, min(rule) AS rule FROM hits_next GROUP BY mint)"
)


def _tick(instant, table):
    counts = ", ".join(f"count(*) FILTER (WHERE rule = '{r}') AS {r}" for r in RULES)
    return f"""SELECT epoch_us({instant}) AS as_of_us, {counts}, count(*) AS affected_count,
        (SELECT count(*) FROM spread r WHERE r.tracking_enabled AND r.mint NOT IN (SELECT mint FROM {table})) AS active_remaining FROM {table}"""


TICKS_OUT = f"{_tick(T, 'firsts')} UNION ALL {_tick(T_NEXT, 'firsts_next')}"

QUERIES = {
    "latest_state": (q_latest_state, _sql(f"""SELECT r.mint, epoch_us(r.last_polled_at) AS last_polled_at_us, epoch_us(l.observed_at) AS latest_at_us,
        round(l.mcap, 6) AS latest_mcap, round(l.liquidity, 6) AS latest_liquidity, CAST(l.holder_count AS DOUBLE) AS latest_holders
        FROM spread r JOIN latest l ON l.mint = r.mint WHERE {LATEST_WHERE}""")),
    "rule2_evidence": (q_rule2_evidence, _sql(f"""SELECT r.mint, epoch_us(a.observed_at) AS checkpoint_at_us, round(a.mcap, 6) AS checkpoint_mcap,
        round(a.liquidity, 6) AS checkpoint_liquidity, sig.n AS changes_in_window
        FROM spread r JOIN asof2 a ON a.mint = r.mint JOIN sig ON sig.mint = r.mint WHERE {SLOT2}""")),
    "rule3_evidence": (q_rule3_evidence, _sql(f"""SELECT r.mint, EXISTS (SELECT 1 FROM snaps s WHERE s.mint = r.mint
        AND s.observed_at <= {T} AND (s.mcap IS NOT NULL OR s.liquidity IS NOT NULL)) AS has_economic FROM spread r WHERE {SLOT3}""")),
    "rule6_evidence": (q_rule6_evidence, _sql(f"""SELECT r.mint, epoch_us(a.observed_at) AS holder_at_us,
        CAST(a.holder_count AS DOUBLE) AS checkpoint_holders FROM spread r JOIN asof6 a ON a.mint = r.mint WHERE {HOLDER_WHERE}""")),
    "source_state": (q_source_state, _sql("""SELECT mint, epoch_us(first_observed_at) AS first_observed_at_us,
        epoch_us(last_polled_at) AS last_polled_at_us, epoch_us(last_changed_at) AS last_changed_at_us FROM spread WHERE tracking_enabled""")),
    "evidence": (q_evidence, _sql(EVIDENCE_SQL, EXTRA + SCAN_ALL)),
    "evidence_carried": (q_evidence_carried, _sql(EVIDENCE_SQL, EXTRA + SCAN_ALL)),
    **{
        f"{rule}_scan": (_scan(rule), _sql(f"""SELECT mint, rule_key, epoch_us(scanned_through) AS scanned_through_us,
        epoch_us(crossing_at) AS crossing_at_us FROM ({_scan_sql(rule, column, True)})"""))
        for rule, column in (("rule4", "liquidity"), ("rule5", "mcap"))
    },
    **{rule: (_rule(rule), _sql(RULE_SQL[rule])) for rule in RULES},
    "lifecycle_cycle": (q_lifecycle_cycle, _sql("SELECT mint, rule, reason FROM firsts", FIRST)),
    "apply_retirement": (q_apply_retirement, _sql(REGISTRY_AFTER, CURSOR_CYCLE)),
    "advance_cursor": (q_advance_cursor, _sql("""SELECT coalesce(c.mint, m.mint) AS mint, coalesce(c.rule_key, m.rule_key) AS rule_key,
        epoch_us(greatest(c.scanned_through, m.scanned_through)) AS scanned_through_us
        FROM cur c FULL JOIN (SELECT s.* FROM scans s LEFT JOIN firsts f ON f.mint = s.mint
            WHERE s.crossing_at IS NULL AND (f.rule IS NULL OR f.rule > s.rule_key)) m ON m.mint = c.mint AND m.rule_key = c.rule_key""", CURSOR_CYCLE)),
    "cycle_summary": (q_cycle_summary, _sql("""SELECT d.rule, (SELECT count(*) FROM firsts f WHERE f.rule = d.rule) AS affected,
        (SELECT count(*) FROM firsts) AS total,
        (SELECT count(*) FROM spread r WHERE r.tracking_enabled AND r.mint NOT IN (SELECT mint FROM firsts)) AS active_remaining
        FROM (SELECT 'rule' || CAST(unnest(range(1, 8)) AS STRING) AS rule) d""", CURSOR_CYCLE)),
    "candidate_diff": (q_candidate_diff, _sql("""(SELECT rule, mint, reason, 'only_left' AS side FROM (SELECT rule, mint, reason FROM firsts EXCEPT SELECT rule, mint, reason FROM firsts2))
        UNION ALL (SELECT rule, mint, reason, 'only_right' AS side FROM (SELECT rule, mint, reason FROM firsts2 EXCEPT SELECT rule, mint, reason FROM firsts))""", DIFF)),
    "tick_series": (q_tick_series, _sql(TICKS_OUT, FIRST + TICKS)),
}
