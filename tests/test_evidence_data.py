"""Temporal summary, risk reports, telemetry, preparation and scoring."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import prep, risk, telemetry as tm, temporal as tp
from tidemark.plans import fixtures as fx

NOW = datetime(2024, 5, 2, 12, 0, 0)
FIELDS = "market_cap liquidity holders organic_score dev_mints dev_balance_pct top_holders_pct".split()


def rows(spark, *points):
    """points: (key, minutes before NOW, metrics, stats)."""
    data = [
        (k, NOW - timedelta(minutes=m), *[None if v.get(f) is None else float(v[f]) for f in FIELDS], {n: float(x) for n, x in (s or {}).items()})
        for k, m, v, s in points
    ]
    schema = "mint string, observed_at timestamp, " + ", ".join(f"{f} double" for f in FIELDS) + ", stats_1h map<string,double>"
    return spark.createDataFrame(data, schema)


def test_history_bound_and_sampling(spark):
    df = rows(spark, ("a", 24 * 60, {"market_cap": 1}, None), ("a", 24 * 60 + 1, {"market_cap": 2}, None), ("a", 7, {"market_cap": 3}, None),
              ("a", 6, {"market_cap": 4}, None), ("a", 4, {"market_cap": None}, None), ("a", -1, {"market_cap": 9}, None))
    kept = tp.history(df, NOW)
    assert sorted(r.market_cap for r in kept.where("market_cap IS NOT NULL").collect()) == [1.0, 3.0, 4.0, 9.0]
    sampled = [r.market_cap for r in tp.sample_5m(kept).orderBy("bucket").collect()]
    assert sampled == [1.0, 4.0, None, 9.0]


def test_drawdown_matches_a_single_pass(spark):
    small = rows(spark, ("a", 3, {"market_cap": 100}, None), ("a", 2, {"market_cap": 250}, None), ("a", 1, {"market_cap": 125}, None),
                 ("flat", 2, {"market_cap": 5}, None), ("neg", 2, {"market_cap": -1}, None), ("neg", 1, {"market_cap": -5}, None), ("none", 1, {}, None))
    got = {r.mint: (r.max_drawdown_pct, r.peak_at) for r in tp.drawdown(small, "market_cap").collect()}
    assert got == {"a": (-50.0, NOW - timedelta(minutes=2)), "flat": (0.0, NOW - timedelta(minutes=2)), "neg": (0.0, NOW - timedelta(minutes=2))}
    rng = random.Random(3)
    series = [rng.choice([-4, 0, 1, 3, 7, 12, 12]) for _ in range(400)]
    points = [("k", (400 - i) * 0.3, {"market_cap": v}, None) for i, v in enumerate(series)]
    peak, worst, top, top_at = None, 0.0, None, None
    for i, v in enumerate(series):
        peak = v if peak is None else max(peak, v)
        if top is None or v > top:
            top, top_at = v, NOW - timedelta(minutes=(400 - i) * 0.3)
        if peak > 0:
            worst = min(worst, (v / peak - 1) * 100)
    for slice_s in (1, 60, 3600, 10**6):
        r = tp.drawdown(rows(spark, *points), "market_cap", slice_s).first()
        assert abs(r.max_drawdown_pct - worst) < 1e-9 and r.peak_at == top_at


def test_summary_sections(spark):
    df = rows(
        spark,
        ("a", 480, {"market_cap": 100, "liquidity": 10, "holders": 5, "top_holders_pct": 40, "dev_mints": 2, "organic_score": 3},
         {"buy_volume": 10, "sell_volume": 10, "buy_organic_volume": 5, "sell_organic_volume": 5}),
        ("a", 0, {"market_cap": 200, "liquidity": None, "holders": None, "top_holders_pct": 45, "organic_score": 9}, {"buy_volume": 30, "sell_volume": 10}),
        ("b", 10, {"market_cap": 0}, None), ("b", 5, {"market_cap": 7}, None), ("c", 5, {}, None),
    )
    got = {r.mint: r for r in tp.temporal_summary(df).collect()}
    a = got["a"]
    assert (a.history.hours, a.history.observations, a.market_cap.change_pct, a.market_cap.start) == (8.0, 2, 100.0, 100.0)
    assert (a.liquidity.current, a.liquidity.liquidity_to_market_cap.median) == (10.0, 0.1)
    assert (a.ownership.top_holders_pct.change_pp, a.ownership.dev_balance_pct, a.ownership.dev_mints_current) == (5.0, None, 2.0)
    buy = a.activity_1h.fields["buy_volume"]
    assert (buy.current, buy.median) == (30.0, 20.0)
    ratio = a.activity_1h.derived.buy_sell_volume_ratio
    assert (ratio.current, ratio.median, ratio.min, ratio.max) == (3.0, 2.0, 1.0, 3.0)
    assert a.activity_1h.derived.net_flow_ratio.current == 0.5 and a.activity_1h.derived.buy_sell_count_ratio is None
    assert (a.organic.score.start, a.organic.score.current, a.organic.score.median, a.organic.volume_share.current) == (3.0, 9.0, 6.0, 0.5)
    b = got["b"]
    assert b.market_cap.change_pct is None and b.market_cap.max_drawdown_pct == 0.0
    assert (b.liquidity, b.holders, b.ownership, b.activity_1h, b.organic) == (None,) * 5
    assert got["c"].history.observations == 1 and got["c"].market_cap is None
    tokens = spark.createDataFrame([("a", "", "S", None)], "mint string, name string, symbol string, launchpad string")
    bundle = tp.summary_bundle(tp.temporal_summary(df), tokens).where("token.mint = 'a'").first()
    assert tuple(bundle.token) == ("a", None, "S", None) and bundle.summary.market_cap.current == 200.0


def reports(spark, *docs):
    data = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(data, "report_id int, body string").select("report_id", F.parse_json("body").alias("report"))


FULL = {
    "score": 7, "score_normalised": 2, "rugged": False, "risks": [{"name": "r", "level": "warn", "score": 5}, {"x": 1}, 3, {"value": None}],
    "creator": "CREATOR", "creatorTokens": [1, 2, 3], "tokenMeta": {"mutable": True, "updateAuthority": "u"},
    "token": {"mintAuthority": None}, "mintAuthority": "top", "freezeAuthority": "top",
    "topHolders": [
        {"address": "A1", "owner": "POOLOWNER", "pct": 12.5, "insider": True}, {"address": "A2", "owner": "CREATOR", "pct": 5, "insider": False},
        {"address": "SELF", "owner": "SELF", "pct": None}, "junk", {"address": 5, "pct": "9", "insider": 1},
    ],
    "knownAccounts": {"A1": {"name": "Pool", "type": "AMM"}, "POOLOWNER": {"name": "Pool", "type": "AMM"}, "CREATOR": {"name": "Dev", "type": "wallet"},
                      "SELF": {"name": "Self", "type": ""}, "bad": 3},
    "markets": [{"marketType": "orca", "lp": {"baseUSD": 200, "quoteUSD": 200, "lpLockedPct": 50}},
                {"marketType": "orca", "lp": {"baseUSD": 100, "lpLockedPct": -1}}, {"marketType": "", "lp": None}, 7],
    "lockers": {"x": 1, "y": 2}, "insiderNetworks": [], "transferFee": {"authority": "", "basisPoints": 10},
}


def test_reports_of_plain_kinds_are_read_in_one_step(spark):
    """A key with a blank in its name makes the same figures come from the value-by-value reading."""

    def report(extra):
        holder = lambda a, o, p, i: {"address": a, "owner": o, "pct": p, "insider": i, **extra}
        return {
            "topHolders": [holder("A", "B", 2.5, True), holder("B", None, 1, False), holder("B", "C", None, None), None],
            "knownAccounts": {"A": {"name": "n", "type": "t", **extra}, "B": {"name": "m", "type": None}, "C": 5},
            "markets": [{"marketType": "X", "lp": {"baseUSD": 1, "lpLockedPct": 2.5}, **extra}, {"marketType": "", "lp": None}],
            "creator": "B",
        }

    df = reports(spark, report({}), report({"x y": 1}), report({"x": "y"}))
    one, walked, other = [r.summary for r in risk.project_report(df).orderBy("report_id").select(F.to_json("summary").alias("summary")).collect()]
    assert one == walked == other and '"labelled_pct":3.5' in one
    # An account is looked up once for its name and its type.
    plan = risk.project_report(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("element_at(") == 1


def test_accounts_are_read_once_per_report(spark):
    """The accounts of a report are no part of the lambda that looks one up, also where nothing else uses them."""
    df = reports(spark, FULL, {"topHolders": [{"address": "A", "pct": 1}]}, {"topHolders": [{"address": "A"}], "knownAccounts": {"A": {"name": "n"}}})
    for rows in (risk.known_labels(df), risk.holder_metrics(df).select("labelled_pct"), risk.project_report(df)):
        text = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "element_at(lambda" in text and text.count("element_at(") == text.count("element_at(lambda")
    got = sorted(tuple(r) for r in risk.known_labels(df).collect() if r.report_id)
    assert got == [(2, "name", "n", 1, None)]


def test_the_first_name_of_a_list_is_tested_as_the_others(spark):
    """Lists whose entries all have the same other kind under the name that comes first, or under the next one."""
    df = reports(
        spark,
        {"topHolders": [{"address": 5, "owner": "A"}], "markets": [{"lp": 1, "marketType": 1}, {"marketType": 2}], "knownAccounts": {"5": {"name": 1, "type": "t"}}},
        {"topHolders": [{"address": "5", "owner": 7}], "markets": [{"lp": {"baseUSD": "1", "quoteUSD": 2}}], "knownAccounts": {"5": {"name": "n", "type": 1}}},
    )
    assert sorted(tuple(r)[:3] for r in risk.known_labels(df).collect()) == [(1, "name", "n")]
    assert risk.market_types(df).count() == 0
    assert [r.largest_market_usd for r in risk.market_metrics(df).orderBy("report_id").collect()] == [None, 2.0]
    checked = risk.leak_check(df, risk.project_report(df)).orderBy("report_id").collect()
    assert [(r.addresses, r.leaks) for r in checked] == [(2, False), (1, False)]


def test_documents_are_read_apart_from_list_functions(spark):
    """A step with functions over lists reads its input from rows, where each use of a variant copies it whole."""
    df = fx.reports(spark, "/root/testdata/sf0.001")
    for rows in (risk.project_report(df), risk.known_labels(df), risk.leak_check(df, risk.project_report(df)), risk.risk_list(df)):
        lines = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        steps = [line for line in lines if "Project [" in line and "variant_get(report#" in line]
        assert steps and not any("lambdafunction" in line for line in steps)


def test_risk_projection(spark):
    df = reports(spark, FULL, {}, {"topHolders": [{"address": "A"}], "markets": {}, "knownAccounts": [], "risks": None, "lockers": 1, "transferFee": 5})
    own = {r.report_id: r for r in risk.holder_metrics(df).collect()}
    a = own[0]
    assert (a.top_holders_reported, a.top1_pct, a.top5_pct, a.top20_pct) == (5, 12.5, 17.5, 17.5)
    assert (a.insider_flags_reported, a.insiders, a.insider_pct, a.creator_pct, a.creator_tokens, a.insider_networks) == (2, 1, 12.5, 5.0, 3, 0)
    assert a.label_types == {"AMM": 1, "wallet": 1} and a.label_names == {"Dev": 1, "Pool": 1, "Self": 1}
    assert a.label_type_pct == {"AMM": 12.5, "wallet": 5.0} and a.label_name_pct == {"Dev": 5.0, "Pool": 12.5}
    assert (a.labelled_pct, a.largest_unlabelled_pct) == (17.5, None)
    b = own[1]
    assert all(v is None for k, v in b.asDict().items() if k != "report_id")
    c = own[2]
    assert (c.top_holders_reported, c.top1_pct, c.insider_flags_reported, c.insiders, c.insider_pct, c.label_types) == (1, None, 0, None, None, None)

    liq = {r.report_id: r for r in risk.market_metrics(df).collect()}
    m = liq[0]
    assert (m.market_count, m.market_types, m.largest_market_usd, m.largest_market_share_pct) == (4, {"orca": 2}, 400.0, 80.0)
    assert (m.markets_with_lock_data, m.markets_with_positive_lock, m.markets_with_zero_lock, m.lockers) == (2, 1, 1, 2)
    assert all(v is None for k, v in liq[1].asDict().items() if k != "report_id") and liq[2].market_count is None and liq[2].lockers is None

    flags = {r.report_id: r for r in risk.control_flags(df).collect()}
    f = flags[0]
    # A nested null hides the top-level value; a missing nested key does not.
    assert (f.mint_authority_present, f.freeze_authority_present, f.metadata_mutable.toPython(), f.metadata_update_authority_present) == (False, True, True, True)
    assert (f.transfer_fee.authority_present, f.transfer_fee.basis_points, f.transfer_fee.max_amount) == (False, "10", None)
    assert flags[1].mint_authority_present is None and flags[1].transfer_fee is None and flags[2].transfer_fee_value == "5"

    risks = {r.report_id: r.risks for r in risk.risk_list(df).collect()}
    assert [(r.name, r.score) for r in risks[0]] == [("r", "5"), (None, None)] and risks[1] is None and risks[2] is None


def test_projection_sizes_and_leaks(spark):
    df = reports(spark, FULL, {})
    projected = risk.project_report(df)
    p = {r.report_id: r.projection for r in projected.collect()}
    assert (p[0].markets_observed, p[0].top_holders_observed, p[0].known_accounts_observed) == (4, 5, 5)
    assert p[0].projected_rough_tokens == -(-p[0].projected_bytes // 4) and p[1].markets_observed is None
    checked = {r.report_id: (r.addresses, r.leaks) for r in risk.leak_check(df, projected).collect()}
    assert checked[0][1] is False and checked[0][0] == 6 and checked[1] == (0, False)
    leaky = projected.withColumn("summary", F.struct(F.lit("see POOLOWNER").alias("text")))
    assert risk.leak_check(df, leaky).where("report_id = 0").first().leaks is True
    long = {(r.metric, r.value) for r in risk.long_form(projected).where("report_id = 0").collect()}
    assert ("score", 7.0) in long and ("insider_pct", 12.5) in long
    assert risk.long_form(projected).where("definition IS NULL").count() == 0
    assert risk.metric_definitions(spark).count() == 8


def test_projection_rounds_and_passes_through(spark):
    df = reports(spark, {"score": "7", "rugged": "yes", "totalHolders": "12", "tokenMeta": {"mutable": "true"}, "topHolders": [{"pct": 1 / 3}, {"pct": 2 / 3}]})
    projected = risk.project_report(df)
    body = json.loads(projected.select(F.to_json("summary")).first()[0])
    assert (body["provider_risk"]["score"], body["provider_risk"]["rugged"]) == ("7", "yes")
    assert (body["ownership"]["total_holders"], body["token_control"]["metadata_mutable"]) == ("12", "true")
    assert (body["ownership"]["top1_pct"], body["ownership"]["top5_pct"]) == (0.666667, 1.0)
    assert {(r.metric, r.value) for r in risk.long_form(projected).collect()} >= {("score", 7.0), ("top10_pct", 1.0)}


def test_valid_key(spark):
    good = "4" * 43
    df = spark.createDataFrame([(good,), (f" {good}\n",), (good[:31],), ("0" * 40,), (None,)], "k string")
    got = [tuple(r) for r in df.select(risk.valid_key(F.col("k")), risk.valid_key(F.col("k"), trim=False)).collect()]
    assert got == [(True, True), (True, False), (False, False), (False, False), (False, False)]


def test_validation_and_forbidden_keys(spark):
    ok = {"type": "search_flush", "at": "t", "polled_tokens": 1, "source_versions": None, "new_snapshots": 1, "write_ms": 1, "queue_size": 0}
    cases = [
        (ok, True), ({**ok, "at": ""}, False), ({**ok, "at": 5}, False), ({**ok, "type": "other"}, False),
        ({k: v for k, v in ok.items() if k != "queue_size"}, False), ({**ok, "x": [{"y": {"API_KEY": 1}}]}, False),
        ({**ok, "note": 'a,"secret":1'}, True), ({**ok, "note": "{"}, True), ({**ok, "secrets": 1}, True), ({**ok, "list": ["secret"]}, True), ([1], False),
    ]
    texts = [(i, json.dumps(c)) for i, (c, _v) in enumerate(cases)] + [(99, "{bad"), (98, '{"s\\u0065cret":1}')]
    df = spark.createDataFrame(texts, "seq int, body string")
    got = {r.seq: r.valid for r in tm.validate_events(df).collect()}
    assert got == {**{i: v for i, (_c, v) in enumerate(cases)}, 99: False, 98: False}
    hidden = df.where("seq = 98").select(tm.has_forbidden_key(F.col("body")).alias("f")).first().f
    assert hidden is True
    counts = tm.validation_counts(tm.validate_events(df)).first()
    assert (counts.received, counts.invalid) == (5, 8)


def test_rolling_rates_and_latest(spark):
    rng = random.Random(5)
    events = sorted((round(rng.uniform(0, 4000), 3), rng.choice(["hot", "hot", "hot", "cold"])) for _ in range(600))
    events += [(5000.0, "edge"), (5060.0, "edge"), (5060.001, "edge")]
    df = spark.createDataFrame([(i, lane, s) for i, (s, lane) in enumerate(events)], "seq int, lane string, s double").selectExpr(
        "seq", "lane", "timestamp_millis(CAST(round(s * 1000) AS BIGINT)) AS at"
    )
    want = {
        i: sum(1 for t, other in events if other == lane and round((s - 60) * 1000) <= round(t * 1000) <= round(s * 1000))
        for i, (s, lane) in enumerate(events)
    }
    assert {r.seq: r.rpm60 for r in tm.rpm60(df, slice_s=90).collect()} == want

    rows_ = spark.createDataFrame(
        [(1, "discovery_tick", "s1", None, "x", 1.0, 5.0), (2, "discovery_tick", "s1", None, "x", None, 7.0), (3, "search_lane_tick", None, "l1", "y", 9.0, 40.0),
         (4, "search_lane_tick", None, "l2", "y", float("nan"), None), (5, "search_lane_tick", None, "l3", "y", 2.0, 60.0), (6, "other", None, None, "z", 1.0, 1.0),
         (7, "search_lane_tick", None, "l3", "y", 2.0, 60.0)],
        "seq int, type string, source string, lane string, at string, rpm60 double, latency_ms double",
    ).withColumns({c: F.col("rpm60") for c in ("response_items", "new_mints", "polled_tokens", "source_versions", "new_snapshots", "affected_count")})
    latest = tm.latest_events(rows_)
    assert {(r.type, r.origin): r.seq for r in latest.collect()} == {
        ("discovery_tick", "s1"): 2, ("search_lane_tick", "l1"): 3, ("search_lane_tick", "l2"): 4, ("search_lane_tick", "l3"): 7}
    stage = tm.stage_metrics(latest).first()
    assert (stage.response_items, stage.rpm60, stage.lanes, stage.median_latency_ms, stage.polled_tokens) == (0.0, 11.0, 3, 50.0, 0.0)
    assert sorted(r.seq for r in tm.dedupe_events(rows_).collect()) == [1, 3, 4, 5, 6]


def test_retention(spark):
    df = spark.createDataFrame(
        [(1, NOW - timedelta(seconds=600), "x"), (2, NOW - timedelta(seconds=601), "x"), (3, NOW, "x"), (4, NOW, "y" * 60_001)], "seq int, received_at timestamp, body string"
    )
    assert sorted(r.seq for r in tm.retain_events(df, NOW, max_bytes=60_000).collect()) == [1, 3]
    assert [r.seq for r in tm.retain_events(df, NOW, max_events=1, max_bytes=60_000).collect()] == [3]


def test_sources_sizes_and_scores(spark):
    refs = spark.createDataFrame(
        [("q", 1, "https://a.b/x", "first"), ("q", 2, "https://a.b/x", "second"), ("q", 3, "javascript:alert(1)", "t"), ("q", 4, "HTTP://c", ""),
         ("q", 5, "http:///path", "t"), ("q", 6, "ftp://d", "t"), ("q", 7, None, "t"), ("r", 1, "https://a.b/x", None)],
        "answer_id string, pos int, url string, title string",
    )
    got = sorted((r.answer_id, r.pos, r.title, r.url) for r in prep.safe_sources(refs).collect())
    assert got == [("q", 1, "first", "https://a.b/x"), ("q", 4, "HTTP://c", "HTTP://c"), ("r", 1, "https://a.b/x", "https://a.b/x")]
    size = prep.context_size(spark.createDataFrame([("äöü12",)], "t string"), "t").first()
    assert (size.bytes, size.rough_tokens_chars, size.rough_tokens_bytes) == (8, 2, 2)
    schema = "case_id int, queried boolean, a string, b int"
    expected = spark.createDataFrame([(1, True, "x", None), (2, False, None, None), (3, True, "x", 1), (4, True, "x", 1), (5, False, None, None)], schema)
    actual = spark.createDataFrame([(1, True, "x", None), (2, False, "noise", 3), (3, True, "x", 2), (5, True, None, None)], schema)
    scored = prep.score_cases(actual, expected, ["a", "b"])
    assert {r.case_id: r.passed for r in scored.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert prep.pass_rate(scored).first().pass_rate == 0.4
