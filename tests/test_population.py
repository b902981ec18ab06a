"""Projection, ranking, search, change feed, activity, pulse and features."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import activity as act, features as ft, feed, projection as pr, pulse as mp, ranking as rk

NOW = datetime(2024, 5, 2, 12, 0, 0)
TYPES = {
    "tracking_enabled": "boolean", "holders": "int", "trades_5m": "int", "traders_5m": "int",
    **{f: "timestamp" for f in ("last_polled_at", "last_changed_at", "snapshot_observed_at", "disabled_at")},
    **{f: "string" for f in ("mint", "name", "symbol", "launchpad", "source_updated_at", "disabled_reason")},
}
SCHEMA = ", ".join(f"{f} {TYPES.get(f, 'double')}" for f in schemas.TOKEN_FIELDS)


def tokens(spark, *rows):
    full = [tuple({"tracking_enabled": True, **r}.get(f) for f in schemas.TOKEN_FIELDS) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_projection(spark):
    registry = spark.createDataFrame(
        [
            ("a", "reg", None, True, None, None),
            ("b", "reg", "S", False, NOW - timedelta(minutes=30), "x"),
            ("c", None, None, False, NOW - timedelta(minutes=30, microseconds=1), "x"),
            ("d", None, None, False, None, "x"),
            ("e", None, None, True, None, None),
        ],
        "mint string, name string, symbol string, tracking_enabled boolean, disabled_at timestamp, disabled_reason string",
    ).withColumns({
        c: F.lit(None).cast("timestamp") for c in ("created_at", "first_pool_created_at", "first_observed_at", "last_polled_at", "last_changed_at")
    }).withColumn("source_updated_at", F.lit("v")).withColumn("last_polled_at", F.lit(NOW - timedelta(seconds=1.5)))
    rows = [(k, NOW - timedelta(seconds=s), s) for k in "abcd" for s in (9, 3)]
    current = spark.createDataFrame(rows, "mint string, observed_at timestamp, holders int").selectExpr(
        "mint", "observed_at", "CASE WHEN holders = 9 THEN 'old' END AS name", "CAST(NULL AS STRING) AS symbol", "CAST(NULL AS STRING) AS launchpad",
        "CAST(holders AS DOUBLE) AS market_cap", "CAST(NULL AS DOUBLE) AS liquidity", "holders", "1 AS trades_5m", "1 AS traders_5m",
        "0D AS buy_volume_5m", "0D AS sell_volume_5m", "0D AS volume_5m",
    )
    active = pr.current_projection(registry, current, NOW).collect()
    assert [r.mint for r in active] == ["a"]
    a = active[0]
    assert (a.name, a.symbol, a.launchpad, a.holders, a.age_seconds, a.poll_age_seconds, a.change_age_seconds) == ("reg", "", "unknown", 3, 3.0, 1.5, None)
    recent = pr.current_projection(registry, current, NOW, 30)
    assert sorted(r.mint for r in recent.collect()) == ["a", "b"]
    assert [r.mint for r in pr.lookup(registry, current, "b", NOW, 30).collect()] == ["b"]
    assert pr.lookup(registry, current, "e", NOW, 30).count() == 0
    shown = pr.normalise_row(recent.where("mint = 'b'")).first()
    assert shown.disabled_at == "2024-05-02T11:30:00+00:00" and shown.last_polled_at == "2024-05-02T11:59:58.500000+00:00"


def test_ranking(spark):
    df = tokens(
        spark,
        *[{"mint": k, "market_cap": float(v), "launchpad": "pad.one" if k in "ba" else "other"} for k, v in zip("bacdef", (1, 1, 3, 4, 5, 6))],
        {"mint": "g", "market_cap": None, "launchpad": ""},
        {"mint": "h", "market_cap": 99.0, "tracking_enabled": False},
        {"mint": "i", "market_cap": None, "tracking_enabled": None},
    )
    top = rk.rank_tokens(df).orderBy("rank").collect()
    assert [(r.rank, r.market_cap) for r in top] == [(1, 6), (2, 5), (3, 4), (4, 3), (5, 1)] and top[-1].mint == "a"
    assert {r.matched_count for r in top} == {6}
    low = rk.rank_tokens(df, "market_cap", "asc", 5, " PAD.ONE ").orderBy("rank").collect()
    assert [r.mint for r in low] == ["a", "b"]
    offers = {r.value: r.active_tokens for r in rk.capabilities(df).collect()}
    assert offers == {"other": 4, "pad.one": 2, "unknown": 2}
    stats = feed.population_stats(df).first()
    assert (stats.active, stats.launchpads) == (7, 3)


@pytest.mark.parametrize(
    "arguments",
    [{"limit": 21}, {"limit": 0}, {"limit": True}, {"limit": "5"}, {"sort_by": "x"}, {"sort_order": "up"}, {"extra": 1},
     {"launchpad": " "}, {"launchpad": 3}, {"launchpad": "nope"}, []],
)
def test_rank_arguments_rejected(arguments):
    with pytest.raises(rk.RankArgumentError):
        rk.validate_rank_args(arguments, ["pad.one"])


def test_rank_arguments_defaults():
    assert rk.validate_rank_args({}) == {"sort_by": "market_cap", "sort_order": "desc", "limit": 5, "launchpad": None}
    assert rk.validate_rank_args({"launchpad": " PAD.one "}, ["pad.one"])["launchpad"] == "PAD.one"


def search_population(spark):
    return tokens(
        spark,
        {"mint": "m1", "symbol": "CAT", "market_cap": 10.0},
        {"mint": "m2", "name": "big cat", "market_cap": 100.0},
        {"mint": "m3", "name": "Cat", "symbol": "b"},
        {"mint": "m4", "name": "Cat", "symbol": "a", "market_cap": float("nan")},
        {"mint": "cat", "market_cap": 1.0},
        {"mint": "m6", "symbol": "cat", "market_cap": 999.0, "tracking_enabled": False},
        {"mint": "m7", "symbol": "dog", "market_cap": 999.0},
    )


def test_search_and_batch_search_agree(spark):
    df = search_population(spark)
    found = [r.mint for r in rk.search_tokens(df, " cat ").orderBy("rank").collect()]
    assert found == ["cat", "m2", "m1", "m4", "m3"]
    assert [r.mint for r in rk.search_tokens(df, "CAT", 2).orderBy("rank").collect()] == ["m2", "m1"]
    assert rk.search_tokens(df, "  ").count() == 0 and rk.search_tokens(df, "cat", 0).count() == 0
    texts = ["cat", "CAT", "c", "og", "m", "g", "big c", "zzz", " ", "t", "at"]
    queries = spark.createDataFrame([(t, t) for t in texts], "query_id string, text string")
    batch = {}
    for r in rk.batch_search(df, queries).orderBy("query_id", "rank").collect():
        batch.setdefault(r.query_id, []).append(r.mint)
    single = {t: [r.mint for r in rk.search_tokens(df, t).orderBy("rank").collect()] for t in texts}
    assert batch == {t: m for t, m in single.items() if m}


def test_diff_and_changes(spark):
    before = tokens(
        spark,
        {"mint": "same", "holders": 1, "age_seconds": 1.0}, {"mint": "up", "market_cap": 1.0, "holders": 0},
        {"mint": "gone", "market_cap": 7.0}, {"mint": "off", "liquidity": 2.0}, {"mint": "dead", "tracking_enabled": False},
        {"mint": "back", "tracking_enabled": False}, {"mint": "null", "liquidity": None},
    )
    after = tokens(
        spark,
        {"mint": "same", "holders": 1, "age_seconds": 9.0, "name": "other"}, {"mint": "up", "market_cap": 3.0, "holders": 5},
        {"mint": "off", "liquidity": 3.0, "tracking_enabled": False, "disabled_reason": "why"}, {"mint": "dead", "tracking_enabled": False, "holders": 4},
        {"mint": "back"}, {"mint": "new"}, {"mint": "null", "liquidity": 1.0},
    )
    events = {r.mint: r for r in feed.population_diff(before, after).collect()}
    assert {k: r.type for k, r in events.items()} == {
        "up": "token_updated", "null": "token_updated", "gone": "token_retired", "off": "token_retired", "back": "token_added", "new": "token_added",
    }
    up = events["up"].changes
    assert tuple(up["market_cap"]) == (2.0, 200.0) and tuple(up["holders"]) == (5.0, None) and tuple(up["liquidity"]) == (None, None)
    assert tuple(events["null"].changes["liquidity"]) == (None, None)
    assert events["gone"].token.market_cap == 7.0 and events["gone"].reason is None
    assert events["off"].token.liquidity == 3.0 and events["off"].reason == "why" and events["off"].changes is None
    state = feed.apply_feed(before, feed.population_diff(before, after).withColumn("seq", F.lit(1)))
    got = {r.mint: (r.tracking_enabled, r.liquidity, r.disabled_reason) for r in state.collect()}
    assert got["off"] == (False, 3.0, "why") and got["gone"][0] is False and got["new"][0] and got["dead"][0] is False
    moves = {r.mint: (r.move, r.visible, r.strong, r.direction) for r in ft.move_flags(feed.population_diff(before, after)).collect()}
    assert moves == {"up": (2.0, True, True, 1)}


def test_apply_feed_order_and_absent_fields(spark):
    state = tokens(spark, {"mint": "a", "name": "n0", "liquidity": 1.0}, {"mint": "b", "name": "keep"}, {"mint": "d", "tracking_enabled": False, "disabled_reason": "old"})

    def event(seq, kind, reason=None, absent=None, **token):
        row = tokens(spark, token).select(F.struct(*schemas.TOKEN_FIELDS).alias("token"))
        return row.select(
            F.lit(seq).alias("seq"), F.lit(kind).alias("type"), F.col("token.mint").alias("mint"), "token",
            F.lit(reason).cast("string").alias("reason"), F.lit(absent).cast("array<string>").alias("absent"),
        )

    events = event(3, "token_retired", None, ["name", "disabled_reason"], mint="a", liquidity=9.0)
    events = events.union(event(2, "token_updated", mint="a", name="n2", liquidity=2.0))
    events = events.union(event(4, "noise", mint="a", name="ignored")).union(event(1, "token_retired", "r", mint="c", disabled_reason="t"))
    events = events.union(event(5, "token_retired", "", ["disabled_reason"], mint="d"))
    got = {r.mint: r for r in feed.apply_feed(state, events).collect()}
    assert (got["a"].name, got["a"].liquidity, got["a"].tracking_enabled, got["a"].disabled_reason) == ("n2", 9.0, False, None)
    assert got["b"].name == "keep" and got["b"].tracking_enabled
    assert (got["c"].tracking_enabled, got["c"].disabled_reason) == (False, "r")
    assert (got["d"].tracking_enabled, got["d"].disabled_reason) == (False, None)  # an old reason does not survive


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.booleans(), st.sampled_from([None, 0.0, 1.0, 2.0])), min_size=1),
    st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.booleans(), st.sampled_from([None, 0.0, 1.0, 2.0])), min_size=1),
)
def test_difference_restores_active_population(spark, left, right):
    def frame(population):
        return tokens(spark, *[{"mint": k, "tracking_enabled": t, "liquidity": v} for k, (t, v) in population.items()])

    events = feed.population_diff(frame(left), frame(right)).withColumn("seq", F.lit(1))
    state = feed.apply_feed(frame(left), events).where("tracking_enabled").select("mint", "liquidity")
    assert sorted(map(tuple, state.collect()), key=str) == sorted(((k, v) for k, (t, v) in right.items() if t), key=str)


def volume_events(spark, rows):
    schema = "seq int, s double, type string, mint string, volume double, mcap double, dv double, dm double"
    return spark.createDataFrame(rows, schema).selectExpr(
        "seq", "timestamp_micros(CAST(s * 1000000 AS BIGINT)) AS ts", "type", "mint",
        "named_struct('volume_5m', volume, 'market_cap', mcap) AS token",
        "map('volume_5m', named_struct('absolute', dv), 'market_cap', named_struct('absolute', dm)) AS changes",
    )


def test_activity(spark):
    u = "token_updated"
    events = volume_events(spark, [
        (1, 1.0, u, "m", 200.0, 1000.0, 100.0, 0.0), (2, 2.0, u, "m", 250.0, 1000.0, 50.0, 0.0), (3, 3.0, u, "falling", 5.0, 10.0, -1.0, 0.0),
        (4, 3.0, u, "flat", 5.0, 10.0, 0.0, 0.0), (5, 3.0, u, "missing", 5.0, None, 1.0, 0.0), (6, 3.0, "token_added", "added", 5.0, 10.0, 1.0, 0.0),
        (7, 3.0, u, "diluted", 20.0, 100.0, 10.0, 60.0),
    ])
    at = lambda s: F.timestamp_micros(F.lit(int(s * 1_000_000)))
    assert act.changed_count(events, at(3)).first().changed == 6
    assert act.changed_count(events, at(62.001)).first().changed == 5
    top = act.top_volume_activity(events, at(3)).collect()
    assert [(r.mint, r.volume_before, r.volume_after, round(r.ratio_change, 9)) for r in top] == [("m", 100.0, 250.0, 0.15)]
    assert act.top_volume_activity(events, at(64)).count() == 0
    many = volume_events(spark, [(i, 1.0, u, f"k{i}", 10.0 + i, 100.0, 5.0 + i, 0.0) for i in range(6)])
    assert [r.mint for r in act.top_volume_activity(many, at(1)).orderBy("rank").collect()] == ["k5", "k4", "k3", "k2", "k1"]


def test_pulse(spark):
    df = tokens(
        spark,
        {"mint": "a", "volume_5m": 100.0, "buy_volume_5m": 60.0, "sell_volume_5m": 40.0, "liquidity": 1000.0, "launchpad": "p"},
        {"mint": "b", "volume_5m": 300.0, "buy_volume_5m": 100.0, "sell_volume_5m": 200.0, "liquidity": 3000.0, "launchpad": "p"},
        {"mint": "c", "volume_5m": 999.0, "tracking_enabled": False, "liquidity": 9.0, "launchpad": "p"},
        {"mint": "d", "tracking_enabled": None, "launchpad": "p"},
    )
    p = mp.market_pulse(df).first()
    assert (p.active_count, p.volume_total, p.buy_volume, p.sell_volume, p.net_volume, p.buy_share_pct) == (2, 400.0, 160.0, 240.0, -80.0, 40.0)
    assert (p.liquidity_total, p.liquidity_median, p.volume_coverage_pct, p.volume_top10_share_pct) == (4000.0, 2000.0, 100.0, 100.0)
    grouped = mp.market_pulse(df, ["launchpad"]).drop("launchpad").first()
    assert grouped == p
    partial = tokens(spark, {"mint": "a", "volume_5m": 0.0}, {"mint": "b", "volume_5m": 5.0}, {"mint": "c", "volume_5m": 1.0, "buy_volume_5m": 1.0}, {"mint": "d", "volume_5m": float("nan")})
    p = mp.market_pulse(partial).first()
    assert (round(p.volume_breadth_pct, 9), p.volume_coverage_pct, p.buy_volume, p.buy_share_pct, p.pressure_known, p.liquidity_total) == (
        round(200 / 3, 9), 75.0, None, None, 0, None)
    empty = mp.market_pulse(df.where("false")).first()
    assert (empty.active_count, empty.volume_total, empty.volume_coverage_pct, empty.liquidity_median) == (0, None, None, None)
    nested = mp.pulse_struct(mp.market_pulse(df)).first()
    assert nested.pressure_5m.net_volume == -80.0 and nested.liquidity.median == 2000.0
    series = df.withColumn("s", F.explode(F.array(*[F.lit(x) for x in (0, 999, 1000, 21_601_000)]))).withColumn(
        "ts", F.timestamp_millis("s")
    )
    kept = sorted(int(r.t) for r in mp.pulse_series(series).select(F.unix_millis("ts").alias("t")).collect())
    assert kept == [1000, 21_601_000]


def test_features(spark):
    df = tokens(spark, *[{"mint": str(i), "market_cap": float(10**i), "holders": i, "launchpad": "p"} for i in range(5)], {"mint": "x", "market_cap": -1.0, "launchpad": "p"})
    limits = ft.robust_log_range(df, "market_cap", 0.0, 1.0)
    scored = ft.normalized_log(df, "market_cap", limits, "score").withColumn("size", ft.size_score(F.col("score")))
    got = {r.mint: (r.score, r["size"]) for r in scored.collect()}
    assert got["0"] == (0.0, 4.0) and got["4"][0] == 1.0 and abs(got["4"][1] - 54.0) < 1e-9 and got["x"] == (None, None)
    flat = ft.robust_log_range(df.where("mint = '2'"), "market_cap").first()
    assert flat.high == flat.low + 1
    assert ft.robust_log_range(df.where("false"), "market_cap").first().low is None
    ages = spark.createDataFrame([(0, 0.0), (1, 30 * 86400.0), (2, -1.0), (3, None), (4, 21600.0), (5, float("inf"))], "i int, a double")
    fresh = [r.f for r in ages.orderBy("i").select(ft.freshness(F.col("a")).alias("f")).collect()]
    assert fresh[:4] == [1.0, 0.0, None, None] and 0.8 < fresh[4] < 0.9 and fresh[5] is None
    holders = {r.mint: r.holder_score for r in ft.holder_scale(df).collect()}
    assert holders["0"] is None and holders["4"] == 1.0 and 0 < holders["1"] < 0.5
    area = ft.group_footprint(scored).first()
    assert area.members == 6 and area.radius >= 88.0
    units = [r.u for r in spark.createDataFrame([("",), ("a",), ("foobar",)], "k string").select(ft.unit_hash(F.col("k")).alias("u")).collect()]
    assert [round(u * 0xFFFFFFFF) for u in units] == [0xD41D8CD9, 0x0CC175B9, 0x3858F622]
