"""Plan properties the operators rely on at scale."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence as ev, pulse as mp, ranking as rk, telemetry as tm, temporal as tp
from tidemark.plans import fixtures as fx
from tidemark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@contextmanager
def options(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_split_and_pre_aggregated(spark):
    with options(
        spark,
        spark__sql__shuffle__partitions="32",
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="200k",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="100k",
    ):
        base = spark.range(0, 300_000, 1, 8).selectExpr(
            "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || (id % 5000) END AS mint",
            "timestamp_micros(1700000000000000 + id * 1000000) AS observed_at",
            "CAST(id % 977 AS DOUBLE) AS mcap", "CAST(id % 353 AS DOUBLE) AS liquidity", "CAST(id % 7 AS DOUBLE) AS holders",
            "true AS has_economic", "CAST(id % 977 AS DOUBLE) AS scan_mcap", "CAST(id % 353 AS DOUBLE) AS scan_liquidity",
        )
        # A registry already partitioned by key, the unfavourable case.
        registry = base.groupBy("mint").agg(F.min("observed_at").alias("created_at")).selectExpr(
            "mint", "true AS tracking_enabled", "created_at", "created_at AS first_observed_at", "created_at AS last_polled_at",
            "created_at AS last_changed_at",
        )
        found = ev.evidence(registry, base, "2023-11-20 00:00:00")
        hot = [r for r in found.collect() if r.mint == "hot"][0]
        text = plan(found)
    assert "skew=true" in text
    # The partial aggregate runs on the split pieces, before the exchange by key.
    final = text.split("== Initial Plan ==")[0]
    assert final.index("HashAggregate") < final.index("skew=true") and "partial_max_by" in final
    assert hot.latest_mcap == float(299_997 % 977)


def test_evidence_is_one_hash_aggregate_over_pruned_columns(spark):
    registry = fx.spread_registry(spark, SF, fx.FULL)
    text = plan(ev.latest_state(registry, fx.lifecycle_rows(spark, SF, fx.FULL), fx.FULL))
    assert "SortAggregate" not in text
    assert "event_type" not in text  # unused columns never leave the file
    assert "min(" not in [line for line in text.splitlines() if "max_by" in line][0]


def test_top_rows_are_limited_before_the_exchange(spark):
    tokens = fx.part_tokens(spark, SF)
    assert "TakeOrderedAndProject" in plan(rk.rank_tokens(tokens))
    grouped = plan(mp.market_pulse(tokens.withColumns({
        "buy_volume_5m": F.lit(1.0), "sell_volume_5m": F.lit(1.0), "launchpad": F.coalesce("launchpad", F.lit("unknown")),
    }), ["launchpad"]))
    assert "WindowGroupLimit" in grouped
    queries = spark.createDataFrame([("red", "red")], "query_id string, text string")
    assert "WindowGroupLimit" in plan(rk.batch_search(tokens, queries))


def test_windows_never_span_a_whole_key(spark):
    rows = fx.history_rows(spark, SF, fx.FULL)
    for line in plan(tp.drawdown(rows, "market_cap")).splitlines():
        if "windowspecdefinition(mint" in line and "observed_at" in line:
            assert "_slice" in line
    lanes = fx.telemetry(spark, SF).where("lane IS NOT NULL").select("seq", "lane", F.col("received_at").alias("at"))
    windows = [line for line in plan(tm.rpm60(lanes)).splitlines() if "windowspecdefinition" in line]
    assert windows and all("_slice" in line for line in windows)


def test_search_never_broadcasts_the_grams(spark, monkeypatch):
    """Queries go to the keys, or both sides are exchanged; the keys' grams look as small as their file."""
    few = plan(QUERIES["batch_search"][0](spark, SF))
    assert "BuildRight" in few and "SortMergeJoin" not in few and "hashpartitioning(_gram" not in few
    monkeypatch.setattr(rk, "SENT_BYTES", 0)
    many = QUERIES["batch_search"][0](spark, SF)
    assert "SortMergeJoin" in plan(many) and "BroadcastHashJoin" not in plan(many)
    monkeypatch.undo()
    assert sorted(many.collect()) == sorted(QUERIES["batch_search"][0](spark, SF).collect())


def test_leak_check_broadcasts_no_texts(spark):
    text = plan(QUERIES["leak_check"][0](spark, SF))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_join_or_python_worker(spark, name):
    text = plan(QUERIES[name][0](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "InPandas"):
        assert word not in text


@pytest.mark.parametrize("name, most", [("cycle_summary", 4), ("advance_cursor", 5), ("append_snapshots", 7)])
def test_scans_of_one_pass(spark, name, most):
    """Evidence, outcome and what follows from it are worked out once."""
    text = plan(QUERIES[name][0](spark, SF))
    assert text.count("FileScan") <= most


def test_one_path_for_all_sizes(spark):
    """Derived inputs are dealt out by the session's setting, never by the size of the table."""
    rows = spark.range(3)
    assert f"RoundRobinPartitioning({spark.conf.get('spark.sql.shuffle.partitions')})" in plan(fx.dealt(rows))
