"""Coercions, payload views and exact quantiles."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from tidemark.functions import coerce as co, quantile
from tidemark.functions.quantile import exact_quantiles
from tidemark.sources import payload as pl


def payloads(spark, values):
    rows = [(i, json.dumps(v) if not isinstance(v, str) else v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, body string").select("i", F.try_parse_json("body").alias("p"))


def values(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_six_number_rules(spark):
    raw = [{"x": v} for v in (1, 2.5, True, False, None, "", "  ", " 4.9 ", "1e3", "1d", "abc", "-inf", "5", [1], {"a": 1})] + [{}]
    df = payloads(spark, raw)
    p, x = F.col("p"), "$.x"
    inf = float("inf")
    assert values(df, co.rule_measure(p, x)) == [1, 2.5, 1, 0, None, None, None, 4.9, 1000, None, None, -inf, 5, None, None, None]
    assert values(df, co.measure(p, x)) == [1, 2.5, None, None, None, None, None, 4.9, 1000, None, None, -inf, 5, None, None, None]
    assert values(df, co.number_only(p, x)) == [1, 2.5] + [None] * 14
    assert values(df, co.integer_measure(p, x)) == [1] + [None] * 11 + [5] + [None] * 3
    blank = [False, False, False, False, True, True, True] + [False] * 8 + [True]
    assert [not v for v in values(df, co.not_blank(co.text_of(p, x)))] == blank
    assert values(df, co.string_only(p, x))[5:9] == ["", "  ", " 4.9 ", "1e3"]
    assert values(df, co.boolean_only(p, x))[:5] == [None, None, True, False, None]


def test_truncation_finiteness_and_time(spark):
    df = spark.createDataFrame(
        [(0, 4.9), (1, -4.9), (2, float("nan")), (3, float("inf")), (4, 1e300), (5, None)], "i int, v double"
    )
    assert values(df, co.whole(F.col("v"))) == [4, -4, None, None, None, None]
    assert values(df, co.finite(F.col("v"))) == [4.9, -4.9, None, None, 1e300, None]
    times = spark.createDataFrame(
        [(0, "2024-01-01T00:00:00Z"), (1, "2024-01-01T02:00:00.000001+02:00"), (2, "2024-01-01T00:00:00"), (3, "x"), (4, "2024-01-01"),
         (5, "12:30:00"), (6, "T12:30"), (7, "2024"), (8, "2024-01"), (9, None), (10, "2024-13-01")], "i int, t string"
    )
    assert values(times, F.unix_micros(co.source_time(F.col("t")))) == [1704067200000000, 1704067200000001, 1704067200000000, None, 1704067200000000] + [None] * 6


def test_payload_views(spark):
    body = {
        "mcap": " ", "liquidity": None, "holderCount": "7", "launchpad": "", "name": None, "symbol": "S", "unknown": [1],
        "stats5m": {"numBuys": None, "numSells": 3, "numTraders": "4.5", "buyVolume": "", "sellVolume": None},
        "stats1h": {"buyVolume": "1.5", "numBuys": 2, "flag": True, "text": "x", "nested": {"a": 1}, "HTTPCode2xx-ok": 3, "num_buys": 9},
        "organicScore": True, "audit": {"devMints": 3},
    }
    df = spark.createDataFrame([("k", json.dumps(body))], "mint string, body string").selectExpr(
        "mint", "timestamp'2024-01-01' AS observed_at", "parse_json(body) AS payload"
    )
    life = pl.lifecycle_view(df).first()
    assert (life.mcap, life.liquidity, life.holders, life.has_economic) == (None, None, 7.0, False)
    cur = pl.current_view(df).first()
    assert (cur.launchpad, cur.name, cur.symbol, cur.holders, cur.trades_5m, cur.traders_5m, cur.volume_5m) == (None, None, "S", 7, 3, None, None)
    hist = pl.history_view(df).first()
    assert hist.stats_1h == {"buy_volume": 1.5, "num_buys": 9.0, "httpcode2xx_ok": 3.0}
    assert (hist.organic_score, hist.dev_mints) == (None, 3.0)


def test_exact_quantiles_against_numpy(spark):
    rng = random.Random(7)
    data = [("hot", float(rng.choice([0, 0, 0, rng.lognormvariate(3, 2)]))) for _ in range(6000)]
    data += [("small", float(v)) for v in (1, 2)] + [("one", 5.0)] + [("odd", None), ("odd", float("nan")), ("odd", float("inf"))]
    df = spark.createDataFrame(data, "g string, v double").repartition(8)
    wanted = {"q05": 0.05, "q50": 0.5, "q995": 0.995, "q1": 1.0, "q0": 0.0}
    got = {r.g: r for r in exact_quantiles(df, "v", wanted, ["g"], accuracy=100).collect()}
    assert set(got) == {"hot", "small", "one"}
    for group in got:
        sample = np.array([v for g, v in data if g == group and v is not None and math.isfinite(v)])
        for name, q in wanted.items():
            assert math.isclose(got[group][name], float(np.quantile(sample, q)), rel_tol=1e-12, abs_tol=1e-12)
    whole = exact_quantiles(df.where("g = 'hot'"), "v", {"m": 0.5}, accuracy=100).first()
    assert math.isclose(whole.m, got["hot"].q50, rel_tol=1e-12)
    assert exact_quantiles(df.where("g = 'none'"), "v", {"m": 0.5}).first().m is None


def test_quantiles_of_ten_million_rows_and_of_null_groups(spark):
    n = 10_000_000
    rows = spark.range(0, n, 1, 16).selectExpr(f"CAST(pmod(id * 7919, {n}) AS DOUBLE) AS v")
    got = exact_quantiles(rows, "v", {"a": 0.05, "m": 0.5, "b": 0.995}).first()
    assert (got.a, got.m, got.b) == tuple(float(np.quantile(np.arange(n), q)) for q in (0.05, 0.5, 0.995))
    groups = spark.createDataFrame([(None, 1, 1.0), (None, 1, 2.0), ("x", None, 5.0), ("x", 1, 7.0)], "g string, h int, v double")
    assert sorted(map(str, exact_quantiles(groups, "v", {"m": 0.5}, ["g", "h"]).collect())) == sorted(
        map(str, [Row(g=None, h=1, m=1.5), Row(g="x", h=None, m=5.0), Row(g="x", h=1, m=7.0)])
    )


@pytest.mark.parametrize("proposal", [-1e9, 499.5, None])
def test_quantiles_survive_any_sketch(spark, monkeypatch, proposal):
    """Whatever range and grid the sketch proposes, counts decide."""
    rows = spark.range(1000).selectExpr("CAST(id DIV 2 * 2 AS DOUBLE) AS v", "CAST(id % 3 AS STRING) AS g")
    wrong = lambda value, cuts, accuracy: F.transform(F.array_repeat(F.lit(proposal).cast("double"), F.size(cuts)), lambda x: x + F.min(value) * 0)
    monkeypatch.setattr(quantile.F, "percentile_approx", wrong)
    for by in ([], ["g"]):
        for r in exact_quantiles(rows, "v", {"a": 0.0, "m": 0.5, "n": 0.77, "b": 1.0}, by).collect():
            sample = [float(i // 2 * 2) for i in range(1000) if not by or str(i % 3) == r.g]
            assert [r.a, r.m, r.n, r.b] == [float(np.quantile(sample, q)) for q in (0.0, 0.5, 0.77, 1.0)]
