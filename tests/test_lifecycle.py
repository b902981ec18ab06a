"""Rule boundaries, evidence bounds, cursors, first match, and the regression anchors of the derived history."""

from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.config import RULES, RuleConfig
from tidemark.operators import evidence as ev, lifecycle as lc
from tidemark.plans import fixtures as fx
from tidemark.plans.common import CFG
from tidemark.plans.cycle import lifecycle_cycle

NOW = datetime(2024, 5, 2, 12, 0, 0)
REGISTRY = (
    "mint string, tracking_enabled boolean, created_at timestamp, first_observed_at timestamp, last_polled_at timestamp, "
    "last_changed_at timestamp, source_updated_at string, disabled_at timestamp, disabled_reason string"
)
MEASURES = (
    "mint string, observed_at timestamp, mcap double, liquidity double, holders double, has_economic boolean, "
    "scan_mcap double, scan_liquidity double"
)


def ago(**kw):
    return NOW - timedelta(**kw)


def key(mint, created=None, first=None, polled=ago(seconds=10), changed=ago(minutes=1), active=True):
    return (mint, active, created, first, polled, changed, "v", None if active else ago(days=1), None if active else "old")


def snap(mint, at, mcap=None, liquidity=None, holders=None, economic=None):
    known = (mcap is not None or liquidity is not None) if economic is None else economic
    as_float = lambda v: None if v is None else float(v)
    return (mint, at, as_float(mcap), as_float(liquidity), as_float(holders), known, as_float(mcap), as_float(liquidity))


def frames(spark, keys, snaps):
    return spark.createDataFrame(keys, REGISTRY), spark.createDataFrame(snaps, MEASURES)


def hits(spark, keys, snaps, rule, cfg=RuleConfig(), cursors=None):
    found = ev.evidence(*frames(spark, keys, snaps), NOW, cfg, cursors)
    return {r.mint: r.reason for r in lc.rule_candidates(found, rule, cfg).collect()}


def test_rule1_thresholds_and_freshness(spark):
    cases = {
        # name: (liquidity, mcap, holders, first observed, polled) -> reason
        "both": ((999, 2999, 299), ago(minutes=10), ago(seconds=60), "liquidity_below_1000_and_mcap_below_3000_and_holders_below_300"),
        "liquidity": ((999, 3000, 1), ago(hours=1), ago(seconds=1), "liquidity_below_1000"),
        "rest": ((1000, 2999, 299.9), ago(hours=1), ago(seconds=1), "mcap_below_3000_and_holders_below_300"),
        "edge": ((1000, 3000, 300), ago(hours=1), ago(seconds=1), None),
        "unknown": ((None, 2999, None), ago(hours=1), ago(seconds=1), None),
        "young": ((1, 1, 1), ago(minutes=10) + timedelta(microseconds=1), ago(seconds=1), None),
        "stale": ((1, 1, 1), ago(hours=1), ago(seconds=60, microseconds=1), None),
        "never polled": ((1, 1, 1), ago(hours=1), None, None),
        "nan": ((float("nan"), float("nan"), float("nan")), ago(hours=1), ago(seconds=1), None),
        "inactive": ((1, 1, 1), ago(hours=1), ago(seconds=1), None),
    }
    keys = [key(n, first=f, polled=p, active=n != "inactive") for n, (_v, f, p, _r) in cases.items()]
    snaps = [snap(n, ago(minutes=5), v[1], v[0], v[2]) for n, (v, *_rest) in cases.items()]
    snaps += [snap(n, ago(minutes=9), 10**6, 10**6, 10**6) for n in cases]  # an older, healthy state does not matter
    assert hits(spark, keys, snaps, "rule1") == {n: c[3] for n, c in cases.items() if c[3]}


def test_rule2_slot_and_evidence(spark):
    created = ago(minutes=30)

    def steps(n):
        return [ago(minutes=20) + timedelta(seconds=i + 1) for i in range(n)]

    keys, snaps, want = [], [], {}

    def case(name, n, mcap, liquidity, hit, created_at=created, first=None, polled=NOW):
        keys.append(key(name, created_at, first or created_at, polled))
        # One state at the start bound itself is outside the window, one after the checkpoint is not part of the state.
        snaps.append(snap(name, created_at + timedelta(minutes=10), mcap, liquidity))
        snaps.extend(snap(name, at, mcap, liquidity) for at in steps(n))
        snaps.append(snap(name, created_at + timedelta(minutes=30, microseconds=1), 1, None))
        if hit:
            want[name] = "early_continuation_failure"

    case("ten", 10, 49_999, 10_000, True)
    case("eleven", 11, 49_999, 10_000, False)
    case("established", 0, 50_000, 5_000, False)
    case("thin", 0, 50_000, 4_999, True)
    case("unknown", 0, None, 10_000, False)
    case("nan", 0, float("nan"), 10_000, True)
    case("early", 0, 1, 1, False, created_at=created + timedelta(microseconds=1))
    case("late", 0, 1, 1, False, created_at=ago(minutes=31))
    case("inside", 0, 1, 1, True, created_at=ago(minutes=31) + timedelta(microseconds=1))
    case("seen late", 0, 1, 1, False, first=created + timedelta(minutes=10, microseconds=1))
    case("not polled", 0, 1, 1, False, polled=created + timedelta(minutes=30) - timedelta(microseconds=1))
    assert hits(spark, keys, snaps, "rule2") == want


def test_rule3_needs_any_economic_text(spark):
    created = ago(minutes=5)
    keys = [key(n, created, created, NOW) for n in ("none", "blank", "text", "future", "known")]
    snaps = [
        snap("blank", ago(minutes=1)),
        snap("text", ago(minutes=1), economic=True),
        snap("future", NOW + timedelta(microseconds=1), mcap=5),
        snap("known", NOW, liquidity=0),
    ]
    reason = "economic_data_missing_at_5m"
    assert hits(spark, keys, snaps, "rule3") == {n: reason for n in ("none", "blank", "future")}


def test_scans_start_at_grace_and_respect_cursors(spark):
    created = ago(hours=2)
    start = created + timedelta(minutes=30)
    keys = [key(n, created, created) for n in ("at", "before", "floor", "seen", "late", "idle")]
    keys.append(key("young", ago(minutes=29), ago(minutes=29)))
    snaps = [
        snap("at", start, 1_999, 1_999),
        snap("before", start - timedelta(microseconds=1), 1, 1),
        snap("before", start, 5_000, 5_000),
        snap("floor", start, 2_000, 2_000),
        snap("seen", start, 1, 1),
        snap("seen", start + timedelta(minutes=2), 9_000, 9_000),
        snap("late", start, 1, 1),
        snap("young", NOW, 1, 1),
    ]
    cursors = spark.createDataFrame(
        [("seen", r, start) for r in ("rule4", "rule5")] + [("late", r, start + timedelta(minutes=1)) for r in ("rule4", "rule5")],
        "mint string, rule_key string, scanned_through timestamp",
    )
    assert set(hits(spark, keys, snaps, "rule4", cursors=cursors)) == {"at"}
    assert set(hits(spark, keys, snaps, "rule5", cursors=cursors)) == {"at"}
    scan = ev.threshold_scan(*frames(spark, keys, snaps), cursors, "rule4", NOW).collect()
    # Nothing unseen: no row. Data older than the cursor is never scanned again.
    assert {r.mint for r in scan} == {"at", "before", "floor", "seen"}


def test_rule6_truncates_and_rule7_bounds(spark):
    first = ago(minutes=30)
    holders = {"four": 4, "almost": 4.9, "five": 5, "unknown": None, "nan": float("nan")}
    keys = [key(n, None, first, NOW) for n in holders]
    snaps = [snap(n, first, holders=v) for n, v in holders.items()]
    snaps += [snap(n, first + timedelta(minutes=30, microseconds=1), holders=0) for n in holders]
    assert set(hits(spark, keys, snaps, "rule6")) == {"four", "almost"}

    cases = {
        "hit": (first, ago(seconds=10), ago(hours=24)),
        "lag bound": (first, ago(seconds=60), ago(hours=25)),
        "recent": (first, ago(seconds=10), ago(hours=24) + timedelta(microseconds=1)),
        "stale": (first, ago(seconds=61), ago(hours=25)),
        "no first": (None, ago(seconds=10), ago(hours=25)),
        "no poll": (first, None, ago(hours=25)),
        "no change": (first, ago(seconds=10), None),
    }
    keys = [key(n, None, *v) for n, v in cases.items()]
    assert set(hits(spark, keys, [snap("other", NOW)], "rule7")) == {"hit", "lag bound"}


def test_cycle_applies_once_and_moves_cursors_forward(spark):
    created = ago(hours=2)
    keys = [key(n, created, created, changed=ago(hours=30) if n == "idle" else ago(minutes=1)) for n in ("drop", "mcap", "idle", "fine")]
    keys.append(key("gone", created, created, active=False))
    at = ago(minutes=3)
    snaps = [
        snap("drop", at, 9_000, 1_500, 400),
        snap("mcap", at, 1_000, 9_000, 400),
        snap("idle", at, 9_000, 9_000, 400),
        snap("fine", at, 9_000, 9_000, 400),
        snap("gone", at, 1, 1, 1),
    ]
    registry, measures = frames(spark, keys, snaps)
    held = spark.createDataFrame(
        [("fine", "rule4", NOW), ("gone", "rule4", created)], "mint string, rule_key string, scanned_through timestamp"
    )
    cycle = lifecycle_cycle(registry, measures, held, NOW)
    found = {r.mint: (r.rule, r.reason) for r in cycle.candidates.collect()}
    assert found == {
        "drop": ("rule4", "liquidity_collapse_below_2000"),
        "mcap": ("rule5", "mcap_collapse_below_2000"),
        "idle": ("rule7", "source_unchanged_for_24h"),
    }
    after = {r.mint: (r.tracking_enabled, r.disabled_reason) for r in cycle.registry.collect()}
    assert after["gone"] == (False, "old") and after["fine"] == (True, None)
    assert after["drop"] == (False, "liquidity_collapse_below_2000")
    moved = {(r.mint, r.rule_key): r.scanned_through for r in cycle.cursors.collect()}
    # Rule 4 ran before rule 5 retired "mcap" and before rule 7 retired "idle"; the newer cursor of "fine" stays.
    assert moved == {
        ("fine", "rule4"): NOW, ("fine", "rule5"): at, ("gone", "rule4"): created,
        ("mcap", "rule4"): at, ("idle", "rule4"): at, ("idle", "rule5"): at,
    }
    summary = {r.rule: r.affected for r in cycle.summary.collect()}
    assert summary == {r: int(r in ("rule4", "rule5", "rule7")) for r in RULES}
    assert {(r.total, r.active_remaining) for r in cycle.summary.collect()} == {(3, 1)}
    again = lifecycle_cycle(cycle.registry, measures, cycle.cursors, NOW)
    assert again.candidates.count() == 0
    dry = lifecycle_cycle(registry, measures, held, NOW, apply=False)
    assert dry.registry is registry and dry.cursors is held
    assert lc.retired_keys(registry, cycle.candidates).count() == 3


def test_candidate_diff(spark):
    schema = "rule string, mint string, reason string"
    a = spark.createDataFrame([("rule1", "x", "r"), ("rule1", "x", "r"), ("rule2", "y", "r")], schema)
    b = spark.createDataFrame([("rule1", "x", "r"), ("rule2", "y", "other")], schema)
    got = {(r.rule, r.mint, r.reason, r.side) for r in lc.candidate_diff(a, b).collect()}
    assert got == {("rule2", "y", "r", "only_left"), ("rule2", "y", "other", "only_right")}
    verdict = {r.rule: r.agrees for r in lc.diff_verdict(a, b).collect()}
    assert verdict == {r: r != "rule2" for r in RULES}


@pytest.mark.parametrize(
    "as_of, alone, first",
    [
        (
            "2024-01-02 12:00:00",
            {"rule1": 44, "rule2": 3, "rule4": 12, "rule5": 13, "rule6": 5, "rule7": 12},
            {"rule1": 44, "rule2": 3, "rule4": 6, "rule5": 3, "rule6": 3, "rule7": 7},
        ),
        ("2024-01-01 12:00:00", {"rule1": 9, "rule3": 1}, {"rule1": 9, "rule3": 1}),
    ],
)
def test_regression_anchors(spark, as_of, alone, first):
    sf = "/root/testdata/sf0.01"
    found = ev.evidence(fx.registry(spark, sf, as_of), fx.lifecycle_rows(spark, sf, as_of), as_of, CFG).persist()
    counts = found.select(*[F.count(lc.RULE_COLUMNS[r](CFG)).alias(r) for r in RULES]).first().asDict()
    assert {r: n for r, n in counts.items() if n} == alone
    matched = {r["rule"]: r["count"] for r in lc.first_match(found, CFG).groupBy("rule").count().collect()}
    assert matched == first
    found.unpersist()


def test_contract_defaults():
    cfg = RuleConfig()
    assert cfg.scaled(60).observation_s == 36_000 and cfg.scaled(60).poll_lag_s == 60 and cfg.scaled(60).inactivity_s == 86_400
    assert replace(cfg, max_changes=3).max_changes == 3
