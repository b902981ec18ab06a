"""Replay of landed responses: the streamed tables equal one batch over the same polls."""

import json
import os
import shutil
import time
from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import DataFrameWriter, functions as F

from tidemark import schemas
from tidemark.config import RuleConfig
from tidemark.plans.cycle import ingest_batch
from tidemark.sources import tables
from tidemark.streaming import collector, feed

T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)


def stamp(seconds):
    return (T0 + timedelta(seconds=seconds)).isoformat().replace("+00:00", "Z")


def response(seq, at, *tokens):
    return {"observed_at": stamp(at), "arrival_seq": seq, "tokens": [json.dumps(t) for t in tokens]}


def token(key, version, **extra):
    return {"id": key, "updatedAt": stamp(version), "name": f"name {key}", "symbol": key, "decimals": 6, "tokenProgram": "p",
            "createdAt": stamp(-100), **extra}


def land(directory, name, responses, mtime):
    path = os.path.join(directory, name)
    with open(path, "w") as f:
        for r in responses:
            f.write(json.dumps(r) + "\n")
    os.utime(path, (mtime, mtime))


@pytest.fixture()
def landed(tmp_path):
    source = str(tmp_path / "in")
    os.mkdir(source)
    base = time.time() - 1000
    land(source, "a.json", [response(1, 10, token("A", 0, mcap=1), token("B", 5)), response(2, 12, token("A", 0, mcap=2))], base)
    land(source, "b.json", [response(3, 20, token("A", 15, mcap=3), token("B", 3)), response(4, 21, {"id": "C"})], base + 10)
    land(source, "c.json", [response(5, 30, token("A", 15), token("D", 28, firstPool={"id": "f", "createdAt": stamp(1)}))], base + 20)
    return source


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def micros(column):
    return F.unix_micros(column) / 1_000_000 - T0.timestamp()


def test_stream_equals_batch_and_is_repeatable(spark, landed, tmp_path):
    root, checkpoint = str(tmp_path / "state"), str(tmp_path / "cp")
    query = collector.run_collector(spark, landed, root, checkpoint, cycle_s=None, max_files=1, available_now=True)
    query.awaitTermination(120)
    assert query.exception() is None
    registry = tables.read_registry(spark, root)
    got = rows(registry, "mint", micros("first_observed_at"), micros("last_polled_at"), micros("last_changed_at"), "name")
    assert got == [("A", 10.0, 30.0, 20.0, "name A"), ("B", 10.0, 20.0, 10.0, "name B"), ("D", 30.0, 30.0, 30.0, "name D")]
    history = tables.read_snapshots(spark, root)
    assert rows(history, "mint", micros("observed_at")) == [("A", 10.0), ("A", 20.0), ("B", 10.0), ("D", 30.0)]

    polls = tables.read_polls(spark, landed)
    assert polls.count() == 7
    batch_form = ingest_batch(polls, spark.createDataFrame([], schemas.REGISTRY), spark.createDataFrame([], schemas.SNAPSHOTS))
    assert rows(batch_form.registry, "mint", "last_polled_at", "source_updated_at") == rows(
        registry, "mint", "last_polled_at", "source_updated_at"
    )

    # Repeating the last batch changes nothing.
    before = whole(spark, root)
    batch = tables.read_polls(spark, landed + "/c.json")
    collector.process_batch(spark, root, batch, 2, writer=str(query.id))
    assert whole(spark, root) == before

    some = spark.createDataFrame([("A",), ("D",), ("unknown",)], "mint string")
    assert rows(tables.read_registry(spark, root, keys=some), "mint") == [("A",), ("D",)]


def test_cycle_retires_and_moves_cursors(spark, landed, tmp_path):
    root = str(tmp_path / "state")
    tables.init_tables(spark, root)
    tables.init_tables(spark, root)  # idempotent
    collector.process_batch(spark, root, tables.read_polls(spark, landed + "/a.json"), 0)
    cfg = RuleConfig(observation_s=1, collapse_grace_s=0)
    collector.process_batch(spark, root, tables.read_polls(spark, landed + "/b.json"), 1, T0 + timedelta(seconds=21), cfg)
    registry = tables.read_registry(spark, root)
    retired = registry.where("NOT tracking_enabled")
    assert rows(retired, "mint", "disabled_reason", micros("disabled_at")) == [("A", "mcap_collapse_below_2000", 21.0)]
    # The liquidity scan of A ended clean before the market-cap rule retired it.
    state = rows(tables.read_rule_state(spark, root), "mint", "rule_key", micros("scanned_through"))
    assert state == [("A", "rule4", 20.0), ("B", "rule4", 10.0), ("B", "rule5", 10.0)]


def whole(spark, root):
    return (
        rows(tables.read_registry(spark, root), "mint", "last_polled_at", "last_changed_at", "tracking_enabled"),
        rows(tables.read_snapshots(spark, root), "mint", "observed_at"),
        rows(tables.read_rule_state(spark, root), "mint", "rule_key", "scanned_through"),
    )


def keys_of(spark, root):
    return [r[0] for r in rows(tables.read_registry(spark, root), "mint")]


def slots(root):
    return sorted(f"{name}/{d}" for name in tables.STATE for d in os.listdir(f"{root}/{name}"))


def test_fresh_checkpoint_on_a_filled_root(spark, landed, tmp_path):
    """A second stream with a checkpoint of its own numbers its batches from zero again; nothing stored is lost."""
    root = str(tmp_path / "state")
    tables.init_tables(spark, root)
    collector.process_batch(spark, root, tables.read_polls(spark, landed + "/a.json"))
    assert keys_of(spark, root) == ["A", "B"]
    late = str(tmp_path / "late")
    os.mkdir(late)
    land(late, "d.json", [response(9, 40, token("E", 39))], time.time())
    for checkpoint in ("first", "second"):
        query = collector.run_collector(spark, late, root, str(tmp_path / checkpoint), cycle_s=None, available_now=True)
        assert query.awaitTermination(120) and query.exception() is None
        assert keys_of(spark, root) == ["A", "B", "E"]
        assert rows(tables.read_snapshots(spark, root), "mint", micros("observed_at")) == [("A", 10.0), ("B", 10.0), ("E", 40.0)]


@pytest.mark.parametrize("cycle", [False, True])
def test_repeated_batch_changes_nothing(spark, landed, tmp_path, cycle):
    root = str(tmp_path / "state")
    tables.init_tables(spark, root)
    cfg = RuleConfig(observation_s=1, collapse_grace_s=0)
    first, second = (tables.read_polls(spark, f"{landed}/{n}.json") for n in "ab")
    collector.process_batch(spark, root, first, 0, writer="w")
    at = T0 + timedelta(seconds=21) if cycle else None
    done = collector.process_batch(spark, root, second, 1, at, cfg, "w")
    before, places = whole(spark, root), slots(root)
    assert collector.process_batch(spark, root, second, 1, at, cfg, "w") == done
    assert whole(spark, root) == before and slots(root) == places
    assert (tables.clock(spark, root).cycle_at is not None) == cycle


def test_attempts_that_failed_half_way_are_completed(spark, landed, tmp_path, monkeypatch):
    root, straight = str(tmp_path / "state"), str(tmp_path / "straight")
    cfg, at = RuleConfig(observation_s=1, collapse_grace_s=0), T0 + timedelta(seconds=21)
    first, second = (tables.read_polls(spark, f"{landed}/{n}.json") for n in "ab")
    for where in (root, straight):
        tables.init_tables(spark, where)
        collector.process_batch(spark, where, first, 0, writer="w")
    collector.process_batch(spark, straight, second, 1, at, cfg, "w")
    write = DataFrameWriter.parquet
    for good in (1, 2):  # the writer dies after so many of its tables
        done = []

        def dying(self, path, *args, **kw):
            if len(done) >= good:
                raise RuntimeError("lost")
            done.append(path)
            return write(self, path, *args, **kw)

        with monkeypatch.context() as patch:
            patch.setattr(DataFrameWriter, "parquet", dying)
            with pytest.raises(RuntimeError, match="lost"):
                collector.process_batch(spark, root, second, 1, at, cfg, "w")
    collector.process_batch(spark, root, second, 1, at, cfg, "w")
    assert whole(spark, root) == whole(spark, straight)


def test_ring_and_bases_keep_every_row(spark, landed, tmp_path, monkeypatch):
    """More batches than slots: the oldest rows survive in the bases and the number of directories is bounded."""
    monkeypatch.setattr(tables, "SLOTS", 4)
    monkeypatch.setattr(tables, "FOLD_EVERY", 2)
    root = str(tmp_path / "state")
    tables.init_tables(spark, root)
    for name in "abc":
        collector.process_batch(spark, root, tables.read_polls(spark, f"{landed}/{name}.json"))
    for k in range(8):
        collector.admit_candidates(spark, root, spark.createDataFrame([("A",), (f"n{k}",), (f"n{k}",), (None,)], "mint string"))
    assert keys_of(spark, root) == ["A", "B", "D", *(f"n{k}" for k in range(8))]
    assert len(os.listdir(root + "/registry")) <= 1 + 4 + 2 + 1
    assert rows(tables.read_registry(spark, root).where("mint = 'A'"), micros("last_polled_at")) == [(30.0,)]


def test_cycles_from_carried_evidence(spark, tmp_path):
    """Cycles start from the folded hours and read the open ones only; a row that comes hours late still counts."""
    cfg = RuleConfig(observation_s=60, collapse_grace_s=600)
    hour = 3600
    batches = [
        [(10, token("A", 10, mcap=9000, liquidity=9000, holderCount=900)), (20, token("B", 20, mcap=9000, liquidity=9000, holderCount=900))],
        [(hour, token("A", hour, mcap=8000, liquidity=8000, holderCount=900)), (hour + 5, token("C", hour, mcap=9000, liquidity=9000, holderCount=900))],
        [(3 * hour, token("A", 3 * hour, mcap=7000, liquidity=7000, holderCount=900))],
        [(1200, token("B", 1200, mcap=100, liquidity=9000, holderCount=900)), (4 * hour, token("C", 4 * hour, mcap=6000, liquidity=6000, holderCount=9))],  # B: hours late
        [(5 * hour, token("A", 5 * hour, mcap=7000, liquidity=500, holderCount=900))],
    ]

    root = str(tmp_path / "state")
    tables.init_tables(spark, root)
    for number, batch in enumerate(batches):
        source = str(tmp_path / str(number))
        os.makedirs(source)
        land(source, "x.json", [response(10 * number + k, at, t) for k, (at, t) in enumerate(batch)], time.time())
        now = T0 + timedelta(seconds=max(at for at, _ in batch) + 5)
        collector.process_batch(spark, root, tables.read_polls(spark, source), number, now, cfg, "w")
    assert rows(tables.read_registry(spark, root), "mint", "disabled_reason", micros("disabled_at")) == [
        ("A", "liquidity_below_1000", 5 * hour + 5.0), ("B", "mcap_collapse_below_2000", 4 * hour + 5.0), ("C", None, None)
    ]
    cursors = rows(tables.read_rule_state(spark, root), "mint", "rule_key", micros("scanned_through"))
    assert cursors == [("A", "rule4", 3.0 * hour), ("A", "rule5", 3.0 * hour), ("B", "rule4", 1200.0), ("C", "rule4", 4.0 * hour), ("C", "rule5", 4.0 * hour)]
    closed = tables.clock(spark, root).closed_until
    assert closed.astimezone(timezone.utc) == T0 + timedelta(hours=4)
    text = tables.read_measures(spark, root, since=closed)._jdf.queryExecution().executedPlan().toString()
    assert "hour" in text.split("PartitionFilters")[1][:200] and "payload" not in text.split("ReadSchema")[1]
    files = {os.path.basename(os.path.dirname(f)) for f in tables.read_measures(spark, root, since=closed).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert files == {"hour=2024050104", "hour=2024050105"}


def test_retention_while_the_stream_runs(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "state")
    os.mkdir(source)
    base = time.time() - 1000
    for k, at in enumerate((0, 1800, 3600 * 3, 3600 * 5 + 1800)):
        land(source, f"{k}.json", [response(k, at, token("A", at), token(f"K{k}", at))], base + 10 * k)
    query = collector.run_collector(
        spark, source, root, str(tmp_path / "cp"), cycle_s=None, max_files=1, available_now=True, retention_hours=4
    )
    assert query.awaitTermination(120) and query.exception() is None
    # 5.5 h minus 4 h: the first two polls are gone, and so is the hour that held them.
    kept = rows(tables.read_snapshots(spark, root), "mint", micros("observed_at"))
    assert kept == [("A", 10800.0), ("A", 19800.0), ("K2", 10800.0), ("K3", 19800.0)]
    assert not [f for f in os.listdir(root + "/snapshots/hour=2024050100") if f.startswith("part-") and pq.read_metadata(f"{root}/snapshots/hour=2024050100/{f}").num_rows]
    assert tables.retain(spark, root, T0 + timedelta(hours=5.5), 4) == 0
    assert keys_of(spark, root) == ["A", "K0", "K1", "K2", "K3"]
    plan = tables.read_snapshots(spark, root, T0 + timedelta(hours=5), T0 + timedelta(hours=6))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "hour" in plan.split("PartitionFilters")[1][:200]


def population(spark, values):
    fields = {f: F.lit(None) for f in schemas.TOKEN_FIELDS}
    types = {
        "tracking_enabled": "boolean", "holders": "int", "trades_5m": "int", "traders_5m": "int",
        **{f: "timestamp" for f in ("last_polled_at", "last_changed_at", "snapshot_observed_at", "disabled_at")},
        **{f: "string" for f in ("mint", "name", "symbol", "launchpad", "source_updated_at", "disabled_reason")},
    }
    df = spark.createDataFrame(values, "mint string, tracking_enabled boolean, volume_5m double, liquidity double")
    return df.select(*[
        (F.col(f) if f in df.columns else fields[f]).cast(types.get(f, "double")).alias(f) for f in schemas.TOKEN_FIELDS
    ])


def test_feed_sequence_skips_empty_batches(spark, tmp_path):
    root = str(tmp_path)
    first = population(spark, [("a", True, 1.0, 5.0), ("b", True, 2.0, 5.0)])
    later = population(spark, [("a", True, 3.0, 5.0), ("c", True, 2.0, 5.0)])
    for batch, rows_ in enumerate([first, first, later, later]):
        feed.publish_tick(spark, root, rows_, T0 + timedelta(seconds=batch), "w", batch)
    assert feed.publish_tick(spark, root, first, T0, "w", 3) == feed.last_tick(spark, root)  # published already
    assert feed.publish_tick(spark, root, later, T0, "other", 0).tick == 4  # another stream counts from zero again
    events = feed.feed_events(spark, root)
    assert rows(events.where("sequence = 1"), "type", "mint") == [("universe_snapshot", "a"), ("universe_snapshot", "b")]
    assert rows(events.where("sequence = 2"), "type", "mint") == [
        ("token_added", "c"), ("token_retired", "b"), ("token_updated", "a"),
    ]
    assert events.where("sequence > 2").count() == 0 and feed.feed_events(spark, root, after=1).count() == 3
    assert sorted(os.listdir(root + "/population")) == ["tick=4"]


def test_pulse_keeps_minimum_gap(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "KEEP_TICKS", 2)
    root = str(tmp_path)
    tokens = population(spark, [("a", True, 1.0, 5.0)])
    base = datetime(2024, 5, 1)
    offsets = [0, 0.999, 1.0, 6 * 3600 + 1.0]
    kept = [feed.publish_tick(spark, root, tokens, base + timedelta(seconds=s)).pulse_at == base + timedelta(seconds=s) for s in offsets]
    assert kept == [True, False, True, True]
    points = feed.pulse_history(spark, root).select("ts").collect()
    assert sorted(p.ts for p in points) == [base + timedelta(seconds=s) for s in (1.0, 6 * 3600 + 1.0)]
    assert sorted(os.listdir(root + "/ticks")) == ["tick=2", "tick=3"]


def test_observer_follows_the_store(spark, landed, tmp_path):
    store, root = str(tmp_path / "store"), str(tmp_path / "out")
    tables.init_tables(spark, store)
    collector.process_batch(spark, store, tables.read_polls(spark, landed + "/a.json"))

    def observe(checkpoint, until):
        query = feed.run_observer(spark, store, root, str(tmp_path / checkpoint))
        try:
            for _ in range(120):
                if feed.last_tick(spark, root).sequence >= until or query.exception():
                    break
                time.sleep(1)
        finally:
            query.stop()
        assert query.exception() is None

    observe("one", 1)
    collector.process_batch(spark, store, tables.read_polls(spark, landed + "/c.json"))
    observe("two", 2)  # a checkpoint of its own on the same feed
    events = feed.feed_events(spark, root)
    assert rows(events.where("sequence = 1"), "type", "mint") == [("universe_snapshot", "A"), ("universe_snapshot", "B")]
    assert ("token_added", "D") in rows(events.where("sequence = 2"), "type", "mint")


def test_windowed_streams(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.createDataFrame(
        [("search_lane_tick", "l1", "t1", 5), ("search_lane_tick", "l1", "t1", 6), ("search_lane_tick", "l1", "t2", 61)],
        "type string, lane string, at string, s int",
    ).selectExpr(
        "type", "CAST(NULL AS STRING) AS source", "lane", "at", "timestamp_seconds(1700000000 + s) AS received_at"
    ).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source)

    def collect(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert collect(feed.dedupe_stream(stream), "deduped", "append").count() == 2
    rates = collect(
        feed.lane_rates_windowed(stream.drop("at").withColumnRenamed("received_at", "at"), 60, 60), "rates", "complete"
    )
    assert rates.agg(F.sum("requests")).first()[0] == 3
    changed = collect(
        feed.changed_keys_windowed(stream.selectExpr("received_at AS ts", "at AS mint"), 60, 60), "changed", "complete"
    )
    assert changed.agg(F.sum("changed")).first()[0] >= 2


def test_a_batch_works_its_versions_out_once(spark, landed, tmp_path, monkeypatch):
    """Registry and history of a batch read the same held versions, and nothing stays held after it."""
    plans = {}

    def seen(name, write, rows_of):
        def wrapped(*args, **kwargs):
            plans[name] = rows_of(args)._jdf.queryExecution().executedPlan().toString()
            return write(*args, **kwargs)

        return wrapped

    monkeypatch.setattr(tables, "append_history", seen("history", tables.append_history, lambda a: a[1]))
    monkeypatch.setattr(tables, "write_state", seen("registry", tables.write_state, lambda a: a[2]["registry"]))
    root = str(tmp_path / "state")
    tables.init_tables(spark, root)
    persistent = spark.sparkContext._jsc.getPersistentRDDs
    held = set(persistent())
    collector.process_batch(spark, root, tables.read_polls(spark, landed + "/a.json"), 0)
    assert "InMemoryTableScan" in plans["history"] and "min_by" in plans["history"]
    assert plans["registry"].count("InMemoryRelation") == 2  # the registry rows, and the versions below them
    assert set(persistent()) == held
