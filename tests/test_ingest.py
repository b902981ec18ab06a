"""Sources, admission, version collapse and merges."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import ingest, registry as reg
from tidemark.plans.cycle import ingest_batch
from tidemark.sources import candidates as cand

T0 = datetime(2024, 5, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def iso(s, zone="Z"):
    return at(s).isoformat() + zone


def bodies(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "body string")


def keys(df):
    return sorted(r.mint for r in df.collect())


def registry(spark, *rows):
    full = [tuple({"tracking_enabled": True, "priority": 1, **r}.get(f) for f in schemas.REGISTRY.names) for r in rows]
    return spark.createDataFrame(full, schemas.REGISTRY)


def polls(spark, *rows):
    """rows: (key, source second, observed second, seq, extra JSON)."""
    data = [
        (k, v if isinstance(v, str) else iso(v), f'{{"id":"{k}","name":"n{seq}","symbol":"s","seq":{seq}{extra}}}', at(o), seq)
        for k, v, o, seq, extra in rows
    ]
    return spark.createDataFrame(data, "id string, updated_at string, body string, observed_at timestamp, arrival_seq long").select(
        "id", "updated_at", F.parse_json("body").alias("payload"), "observed_at", "arrival_seq"
    )


def test_candidates(spark):
    recent = bodies(spark, '[{"id":"a"},{"id":""},{"x":1},5,null,{"id":7},{"id":"a"}]', "{bad", "{}", "[]")
    assert keys(cand.candidates_from_recent(recent)) == ["a", "a"]
    pools = bodies(spark, '[{"token_x":{"address":"p"},"token_y":{"address":"q"}},{"token_x":null,"token_y":{"address":"p"}},{"token_x":"p"},3]')
    assert keys(cand.candidates_from_pools(pools)) == ["p", "p", "q"]
    messages = bodies(spark, '{"mint":"m"}', '{"mint":5}', '{"mint":""}', '{"other":1}', "[1]", "no json")
    assert keys(cand.candidates_from_messages(messages)) == ["m"]


def test_admission_and_discovery(spark):
    known = registry(spark, {"mint": "old", "tracking_enabled": False, "disabled_reason": "x"})
    frames = {
        "one": spark.createDataFrame([("new",), ("new",), ("old",)], "mint string"),
        "two": spark.createDataFrame([("new",), ("late",)], "mint string"),
    }
    found = cand.union_sources(frames)
    after = {r.mint: (r.tracking_enabled, r.priority, r.disabled_reason) for r in ingest.admit(found, known).collect()}
    assert after == {"old": (False, 1, "x"), "new": (True, 1, None), "late": (True, 1, None)}
    tick = {r.source: (r.candidate_occurrences, r.unique_candidates, r.new_keys) for r in ingest.discovery_tick(found, known).collect()}
    assert tick == {"one": (3, 2, 1), "two": (2, 2, 1)}
    rows = registry(spark, {"mint": "b"}, {"mint": "a"}, {"mint": "c", "priority": 2}, {"mint": "d", "tracking_enabled": False})
    assert [r.mint for r in reg.active_by_priority(rows).collect()] == ["a", "b"]
    assert reg.active_count(rows).first().active == 3
    pairs = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 1)], "k string, n int")
    assert sorted((r.k, r.rows, r.has_null) for r in reg.audit_keys(pairs, ["k", "n"]).collect()) == [("a", 2, False), ("b", 1, True)]


def test_collapse_keeps_first_arrival(spark):
    rows = polls(spark, ("a", 0, 50, 2, ""), ("a", 0, 40, 1, ""), ("a", 0, 90, 3, ""), ("a", iso(0, "+00:00"), 60, 4, ""), ("a", 9, 70, 5, ""))
    got = {r.updated_at: r for r in ingest.collapse_versions(rows).withColumn("seq", F.expr("variant_get(payload, '$.seq', 'int')")).drop("payload").collect()}
    assert len(got) == 3
    first = got[iso(0)]
    assert (first.seq, first.observed_at, first.last_polled_at) == (1, at(40), at(90))
    # The same instant written differently is another version of the same source time.
    assert got[iso(0, "+00:00")].source_time == first.source_time


def test_merges(spark):
    known = registry(
        spark,
        {"mint": "a", "name": "kept", "source_updated_at": iso(10), "first_observed_at": at(1), "last_polled_at": at(500), "last_changed_at": at(12)},
        {"mint": "b", "source_updated_at": iso(10), "last_polled_at": at(5), "last_changed_at": at(11)},
        {"mint": "c", "name": "idle", "last_polled_at": at(3)},
        {"mint": "blank", "tracking_enabled": False},
    )
    rows = polls(
        spark,
        ("a", 30, 100, 1, ""), ("a", 20, 120, 2, ""), ("a", 10, 130, 3, ""), ("a", 5, 140, 4, ""),
        ("b", 10, 100, 5, ',"firstPool":{"id":"f","createdAt":"2024-01-01T00:00:00Z"},"createdAt":"","audit":{"mintAuthorityDisabled":true}'), ("b", 9, 200, 6, ""),
        ("new", 1, 100, 7, ',"firstPool":null,"decimals":9,"createdAt":"2024-01-02T00:00:00Z"'), ("blank", 3, 100, 8, ""),
    )
    stored = spark.createDataFrame([("a", at(120))], "mint string, observed_at timestamp")
    batch = ingest_batch(rows, known, stored)
    got = {r.mint: r for r in batch.registry.collect()}
    assert set(got) == {"a", "b", "new", "blank"}
    a = got["a"]
    # The newest source version was seen before an older one; its own instant counts as the change.
    assert (a.name, a.source_updated_at, a.last_changed_at, a.first_observed_at, a.last_polled_at) == ("kept", iso(30), at(100), at(1), at(500))
    b = got["b"]
    # Nothing newer: only the poll moves; the name comes from the newest polled version all the same.
    assert (b.name, b.source_updated_at, b.last_changed_at, b.first_observed_at, b.last_polled_at) == ("n5", iso(10), at(11), None, at(200))
    assert (b.first_pool_id, b.created_at, b.mint_authority_disabled, b.freeze_authority_disabled) == ("f", None, True, None)
    n = got["new"]
    assert (n.name, n.decimals, n.tracking_enabled, n.priority, n.first_pool_id, n.created_at) == ("n7", 9, True, 1, None, datetime(2024, 1, 2))
    assert got["blank"].tracking_enabled is False and got["blank"].name == "n8"
    added = sorted((r.mint, r.observed_at) for r in batch.snapshots.select("mint", "observed_at").collect())
    assert added == [("a", at(100)), ("blank", at(100)), ("new", at(100))]
    summary = batch.summary.first()
    assert (summary.enriched_keys, summary.offered_snapshots, summary.added_snapshots) == (3, 4, 3)


def test_same_instant_keeps_oldest_source_version(spark):
    rows = polls(spark, ("a", 20, 100, 1, ""), ("a", 10, 100, 2, ""))
    newer = ingest.newer_versions(ingest.collapse_versions(rows), registry(spark))
    empty = spark.createDataFrame([], "mint string, observed_at timestamp")
    kept = ingest.append_snapshots(newer, empty).select(F.expr("variant_get(payload, '$.seq', 'int') AS seq")).collect()
    assert [r.seq for r in kept] == [2]


def test_retention_is_inclusive(spark):
    now = datetime(2026, 8, 12, 9, 30)
    rows = spark.createDataFrame(
        [("keep", now - timedelta(hours=24)), ("drop", now - timedelta(hours=24, microseconds=1))], "mint string, observed_at timestamp"
    )
    assert keys(ingest.expire_snapshots(rows, now)) == ["keep"]
    assert ingest.expired_count(rows, now).first().deleted == 1
    assert ingest.strip_private(rows.withColumn("_observed_at", F.lit(1))).columns == ["mint", "observed_at"]
