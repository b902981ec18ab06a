"""The carried state against the fold over the whole history, cycle by cycle."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.config import RuleConfig
from tidemark.operators import evidence as ev, evidence_state as es, lifecycle as lc
from tests.test_lifecycle import MEASURES, REGISTRY

T0 = datetime(2024, 5, 1)
CYCLES = 5
COLUMNS = [
    "mint", "latest_at", "latest_mcap", "latest_liquidity", "latest_holders", "checkpoint_at", "checkpoint_mcap", "checkpoint_liquidity",
    "changes_in_window", "has_economic", "holder_at", "checkpoint_holders", "rule4_scanned", "rule4_crossing", "rule5_scanned", "rule5_crossing",
]


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*COLUMNS).collect())


def replay(draw, name):
    """Keys of one replay and their rows with the cycle in which each arrives: mostly that of its instant, some later."""
    keys, history = [], []
    for k in range(6):
        mint, created = f"{name}-{k}", T0 + timedelta(minutes=draw.randrange(-60, 90))
        keys.append((mint, True, draw.choice([created, created, None]), created + timedelta(minutes=draw.randrange(20)), T0 + timedelta(hours=9), T0, "v", None, None))
        for at in sorted(draw.sample(range(60 * CYCLES), draw.randrange(25))):
            mcap, liquidity = (draw.choice([None, float("nan"), 500.0, 3000.0, 60_000.0]) for _ in range(2))
            row = (mint, T0 + timedelta(minutes=at), mcap, liquidity, float(draw.randrange(9)), draw.random() < 0.5, mcap, liquidity)
            history.append((*row, min(CYCLES - 1, at // 60 + draw.choice([0] * 6 + [1, 2, 3]))))
    return keys, history


def test_twenty_replays_equal_the_full_fold(spark, tmp_path):
    draw, cfg = random.Random(11), RuleConfig(observation_s=300, collapse_grace_s=900)
    keys, history = zip(*(replay(draw, n) for n in range(20)))
    registry = spark.createDataFrame(sum(keys, []), REGISTRY)
    arrivals = spark.createDataFrame(sum(history, []), MEASURES + ", cycle int").cache()
    cursors = spark.createDataFrame([], "mint string, rule_key string, scanned_through timestamp")
    state, boundary, retired, late_rows = spark.createDataFrame([], es.SCHEMA), T0, 0, 0
    for cycle in range(CYCLES):
        as_of = T0 + timedelta(hours=cycle + 1)
        arrived, own = arrivals.where(F.col("cycle") <= cycle).drop("cycle"), arrivals.where(F.col("cycle") == cycle).drop("cycle")
        late = own.where(F.col("observed_at") < F.lit(boundary))
        late_rows += late.count()
        held = arrivals.where((F.col("cycle") < cycle) & (F.col("observed_at") < F.lit(boundary))).drop("cycle")
        state = es.renewed(registry, state, held, es.outdated(registry, state, cfg, cursors), cfg, cursors)
        state = es.merge(state, es.fold(registry, late, cfg, cursors))
        open_rows = arrived.where(F.col("observed_at") >= F.lit(boundary))
        got = es.carried(registry, state, open_rows, as_of, cfg, cursors)
        want = ev.evidence(registry, arrived, as_of, cfg, cursors).cache()
        assert rows(got) == rows(want)

        closing = T0 + timedelta(hours=cycle)  # the hour before this one is closed; the newest stays open
        state = es.merge(state, es.fold(registry, open_rows.where(F.col("observed_at") < F.lit(closing)), cfg, cursors))
        boundary = closing
        outcome = lc.outcome(want, cfg)
        moved = ev.advance_cursor(cursors, lc.clean_scans(outcome))
        after = lc.apply_retirement(registry, lc.candidates(outcome), as_of)
        if cycle == 2:  # the registry learns some creations late
            after = after.withColumn("created_at", F.coalesce("created_at", F.col("first_observed_at")))
        for name, frame in (("state", state), ("cursors", moved), ("registry", after)):
            frame.write.parquet(f"{tmp_path}/{cycle}/{name}")
        state, cursors, registry = (spark.read.parquet(f"{tmp_path}/{cycle}/{n}") for n in ("state", "cursors", "registry"))
        retired = registry.where("NOT tracking_enabled").count()
    assert retired > 10 and late_rows > 20


def test_expired_rows_are_gone(spark):
    registry = spark.createDataFrame([("a", True, T0, T0, T0, T0, "v", None, None)], REGISTRY)
    measures = spark.createDataFrame([("a", T0 + timedelta(minutes=m), 1.0, 1.0, 1.0, True, 1.0, 1.0) for m in (5, 40, 50)], MEASURES)
    state = es.fold(registry, measures)
    for minutes in (0, 10, 45, 60):
        since = T0 + timedelta(minutes=minutes)
        kept = measures.where(F.col("observed_at") >= F.lit(since))
        stale = es.outdated(registry, state, since=since)
        held = es.renewed(registry, state, kept, stale)
        got, want = (rows(df.withColumn("has_economic", F.lit(True)).withColumn("changes_in_window", F.lit(0)))
                     for df in (es.finish(registry, held, T0 + timedelta(hours=2), since=since), ev.evidence(registry, kept, T0 + timedelta(hours=2))))
        assert got == want


def test_merge_needs_one_exchange_and_no_rows(spark, tmp_path):
    registry = spark.createDataFrame([("a", True, T0, T0, T0, T0, "v", None, None)], REGISTRY)
    state = es.fold(registry, spark.createDataFrame([], MEASURES))
    state.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    text = es.merge(stored, stored)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "SortAggregate" not in text
