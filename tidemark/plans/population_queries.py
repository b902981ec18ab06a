"""Registered queries: projection, ranking, search, change feed, pulse and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import (
    activity as act,
    evidence as ev,
    features as ft,
    feed,
    lifecycle as lc,
    projection as pr,
    pulse as mp,
    ranking as rk,
)
from tidemark.plans import fixtures as fx
from tidemark.plans.common import CFG, tidy
from tidemark.session import shared_dir
from tidemark.sources import newest

NOW, BEFORE = fx.FULL, fx.BEFORE
T, T0 = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{BEFORE}'"
RECENT_MINUTES = 30


def projection(spark, sf, recent=None):
    return pr.current_projection(fx.registry(spark, sf, NOW), fx.current_rows(spark, sf, NOW), NOW, recent)


def population(spark, sf, as_of):
    """Population at one instant; at the later one the keys unchanged for a day are retired."""
    registry = fx.registry(spark, sf, as_of, 20 if as_of == BEFORE else 25)
    if as_of == NOW:
        found = lc.rule_candidates(ev.evidence(registry, fx.lifecycle_rows(spark, sf, as_of), as_of, CFG), "rule7", CFG)
        registry = lc.apply_retirement(registry, found, as_of)
    return pr.current_projection(registry, fx.current_rows(spark, sf, as_of), as_of, recent_minutes=1_000_000)


def _token_sql(latest, reg, now, extra_where):
    return f"""SELECT l.mint, coalesce(l.name, r.name, '') AS name, coalesce(l.symbol, '') AS symbol, l.launchpad, r.tracking_enabled,
    l.mcap AS market_cap, l.liquidity, l.holder_count AS holders,
    CASE WHEN l.num_buys IS NOT NULL OR l.num_sells IS NOT NULL THEN coalesce(l.num_buys, 0) + coalesce(l.num_sells, 0) END AS trades_5m,
    l.num_traders AS traders_5m, l.buy_volume AS buy_volume_5m, l.sell_volume AS sell_volume_5m,
    CASE WHEN l.buy_volume IS NOT NULL OR l.sell_volume IS NOT NULL THEN coalesce(l.buy_volume, 0) + coalesce(l.sell_volume, 0) END AS volume_5m,
    (epoch_us({now}) - epoch_us(r.created_at)) / CAST(1000000 AS DOUBLE) AS age_seconds,
    (epoch_us({now}) - epoch_us(r.last_polled_at)) / CAST(1000000 AS DOUBLE) AS poll_age_seconds,
    (epoch_us({now}) - epoch_us(r.last_changed_at)) / CAST(1000000 AS DOUBLE) AS change_age_seconds,
    r.last_polled_at, r.last_changed_at, r.source_updated_at, l.observed_at AS snapshot_observed_at, r.disabled_at, r.disabled_reason
    FROM {latest} l JOIN {reg} r ON r.mint = l.mint WHERE {extra_where}"""


PROJECTION_OUT = """mint, name, symbol, launchpad, tracking_enabled, round(market_cap, 6) AS market_cap, round(liquidity, 6) AS liquidity,
    CAST(holders AS BIGINT) AS holders, CAST(trades_5m AS BIGINT) AS trades_5m, CAST(traders_5m AS BIGINT) AS traders_5m,
    round(buy_volume_5m, 6) AS buy_volume_5m, round(sell_volume_5m, 6) AS sell_volume_5m, round(volume_5m, 6) AS volume_5m,
    round(age_seconds, 6) AS age_seconds, round(poll_age_seconds, 6) AS poll_age_seconds, round(change_age_seconds, 6) AS change_age_seconds,
    epoch_us(last_polled_at) AS last_polled_at_us, epoch_us(last_changed_at) AS last_changed_at_us, source_updated_at,
    epoch_us(snapshot_observed_at) AS snapshot_observed_at_us, epoch_us(disabled_at) AS disabled_at_us, disabled_reason"""
VISIBLE = f"r.tracking_enabled OR r.disabled_at >= {T} - INTERVAL '{RECENT_MINUTES}' MINUTE"

# Populations of the feed. The earlier one uses its own registry; both keep long-retired keys visible.
REG_AT = fx.ctes(BEFORE, 20)
POPULATIONS = f"""snaps0 AS (SELECT * FROM snaps WHERE observed_at <= {T0}),
latest0 AS ({fx.ctes()['latest'].replace('FROM snaps', 'FROM snaps0')}),
reg0 AS ({REG_AT['reg'].replace('FROM snaps', 'FROM snaps0')}),
reg1 AS (SELECT * REPLACE (tracking_enabled AND NOT retire AS tracking_enabled,
    CASE WHEN retire THEN {T} ELSE disabled_at END AS disabled_at,
    CASE WHEN retire THEN 'source_unchanged_for_24h' ELSE disabled_reason END AS disabled_reason) FROM
    (SELECT *, tracking_enabled AND epoch_us({T}) - epoch_us(last_polled_at) <= 60000000
        AND epoch_us({T}) - epoch_us(last_changed_at) >= 86400000000 AS retire FROM reg)),
prev AS ({_token_sql('latest0', 'reg0', T0, 'r.tracking_enabled OR r.disabled_at IS NOT NULL')}),
curr AS ({_token_sql('latest', 'reg1', T, 'r.tracking_enabled OR r.disabled_at IS NOT NULL')})"""
DELTA = ("market_cap", "liquidity", "holders", "trades_5m", "traders_5m", "buy_volume_5m", "sell_volume_5m", "volume_5m")
SAME = " AND ".join(
    f"p.{f} IS NOT DISTINCT FROM c.{f}" for f in ("tracking_enabled", "source_updated_at", "last_changed_at", *DELTA)
)
DIFF = f"""diff AS (SELECT * FROM (SELECT coalesce(c.mint, p.mint) AS mint,
    CASE WHEN c.tracking_enabled AND (p.mint IS NULL OR NOT p.tracking_enabled) THEN 'token_added'
         WHEN c.tracking_enabled AND NOT ({SAME}) THEN 'token_updated'
         WHEN p.tracking_enabled AND (c.mint IS NULL OR NOT c.tracking_enabled) THEN 'token_retired' END AS type,
    c.disabled_reason, coalesce(c.market_cap, CASE WHEN c.mint IS NULL THEN p.market_cap END) AS token_market_cap,
    {', '.join(f'CAST(c.{f} AS DOUBLE) - CAST(p.{f} AS DOUBLE) AS {f}_abs, CASE WHEN p.{f} <> 0 THEN (CAST(c.{f} AS DOUBLE) - CAST(p.{f} AS DOUBLE)) / abs(CAST(p.{f} AS DOUBLE)) * 100 END AS {f}_pct' for f in DELTA)},
    c.market_cap AS c_mcap, p.market_cap AS p_mcap
    FROM prev p FULL JOIN curr c ON c.mint = p.mint) WHERE type IS NOT NULL)"""


def pop_sql(body, extra=""):
    return fx.with_ctes(("latest", "reg"), body, NOW, 25, POPULATIONS + (",\n" + extra if extra else ""))


def q_current_projection(spark, sf):
    return tidy(projection(spark, sf))


def q_projection_bucketed(spark, sf):
    """The same projection from bucketed tables: the newest state of the older days, refreshed with the rows that came since."""
    root, buckets = shared_dir(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, known = fx.current_rows(spark, sf, NOW), F.col("observed_at") <= F.lit(BEFORE).cast("timestamp")
    state = newest.refresh(spark, newest.create_newest(f"{root}/newest", rows.where(known), buckets), rows.where(~known))
    registry = newest.create(f"{root}/registry", fx.registry(spark, sf, NOW), buckets)
    return tidy(pr.project_newest(registry.read(spark), state.read(spark), NOW))


def q_visible_recent(spark, sf):
    return tidy(projection(spark, sf, RECENT_MINUTES))


def q_normalised_rows(spark, sf):
    return tidy(pr.normalise_row(projection(spark, sf, RECENT_MINUTES)).select("mint", "launchpad", "last_changed_at", "disabled_at", "holders"))


# A key that was retired shortly before the instant.
LOOKED_UP = "M000020"


def q_token_lookup(spark, sf):
    return tidy(pr.lookup(fx.registry(spark, sf, NOW), fx.current_rows(spark, sf, NOW), LOOKED_UP, NOW, RECENT_MINUTES))


def q_capabilities(spark, sf):
    return rk.capabilities(fx.part_tokens(spark, sf))


def q_rank_desc(spark, sf):
    return tidy(rk.rank_tokens(fx.part_tokens(spark, sf), "holders", "desc", 20))


def q_rank_result(spark, sf):
    """One ranking with matches and one without, each as one row."""
    tokens = fx.part_tokens(spark, sf)
    some = rk.rank_result(tokens, "market_cap", "asc", 7, " BRAND#7 ")
    none = rk.rank_result(tokens.withColumn("volume_5m", F.lit(None).cast("double")), "volume_5m", "desc", 3)
    keys = F.array_join(F.transform("tokens", lambda t: t["mint"]), ",").alias("mints")
    return some.union(none).select("sort_by", "sort_order", "launchpad", "matched_count", "returned_count", keys)


def q_rank_asc_filtered(spark, sf):
    return tidy(rk.rank_tokens(fx.part_tokens(spark, sf), "market_cap", "asc", 10, "brand#7"))


def q_search_tokens(spark, sf):
    found = rk.search_tokens(fx.part_tokens(spark, sf), "Red", 8)
    return tidy(found.select("rank", "mint", "symbol", "name", "market_cap"))


def search_queries(spark, sf):
    parts = fx.table(spark, sf, "part")
    texts = parts.select(F.col("p_name").alias("text")).union(parts.select(F.lower("p_type"))).distinct()
    return texts.select(F.col("text").alias("query_id"), "text")


def q_batch_search(spark, sf):
    return tidy(rk.batch_search(fx.part_tokens(spark, sf), search_queries(spark, sf)))


def diff(spark, sf):
    return feed.population_diff(population(spark, sf, BEFORE), population(spark, sf, NOW))


def q_population_diff(spark, sf):
    columns = [
        c
        for f in DELTA
        for c in (
            F.col("changes")[f]["absolute"].alias(f"{f}_abs"),
            F.col("changes")[f]["percent"].alias(f"{f}_pct"),
        )
    ]
    return tidy(diff(spark, sf).select("type", "mint", "reason", F.col("token.market_cap").alias("token_market_cap"), *columns))


def q_apply_feed(spark, sf):
    state = feed.apply_feed(population(spark, sf, BEFORE), fx.changes(spark, sf))
    return tidy(
        state.select("mint", "name", "launchpad", "tracking_enabled", "market_cap", "liquidity", "holders", "disabled_reason")
    )


def q_feed_round_trip(spark, sf):
    """Active keys after applying the difference to the earlier population: those of the later one."""
    events = diff(spark, sf).withColumn("seq", F.lit(1))
    state = feed.apply_feed(population(spark, sf, BEFORE), events)
    return tidy(state.where("tracking_enabled").select("mint", "market_cap", "source_updated_at"))


def q_population_stats(spark, sf):
    return feed.population_stats(fx.part_tokens(spark, sf))


WINDOW_S = 15 * 86400
END = "2024-01-30 12:00:00"


def q_changed_count(spark, sf):
    return act.changed_count(fx.changes(spark, sf), END, WINDOW_S)


def q_volume_signals(spark, sf):
    return tidy(act.volume_signals(fx.changes(spark, sf)).drop("ts"))


def q_top_volume(spark, sf):
    return tidy(act.top_volume_activity(fx.changes(spark, sf), END, WINDOW_S))


def q_market_pulse(spark, sf):
    return tidy(mp.market_pulse(population(spark, sf, NOW)), 4)


def q_market_pulse_by_group(spark, sf):
    return tidy(mp.market_pulse(population(spark, sf, NOW), ["launchpad"]), 4)


def series(spark, sf):
    rows = fx.snapshots(spark, sf, NOW).selectExpr(
        "date_trunc('MINUTE', observed_at) AS ts",
        "mint",
        "user_id % 20 <> 0 AS tracking_enabled",
        "CASE WHEN buy_volume IS NOT NULL OR sell_volume IS NOT NULL THEN coalesce(buy_volume, 0) + coalesce(sell_volume, 0) END AS volume_5m",
        "buy_volume AS buy_volume_5m",
        "sell_volume AS sell_volume_5m",
        "liquidity",
    )
    return rows


def q_pulse_series(spark, sf):
    return tidy(mp.pulse_series(series(spark, sf), every_s=6 * 3600, keep_s=20 * 86400), 4)


def q_pulse_series_spaced(spark, sf):
    return tidy(mp.spaced_pulse_series(series(spark, sf), every_s=5 * 3600 + 420, keep_s=20 * 86400), 4)


def pulse_sql(source, by=""):
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = (lambda name: f"LEFT JOIN {name} USING ({by})") if by else (lambda name: f", {name}")
    return f"""act AS (SELECT * FROM {source} WHERE tracking_enabled),
top AS (SELECT {key} sum(volume_5m) AS top_volume FROM (SELECT *, row_number() OVER ({f'PARTITION BY {by}' if by else ''} ORDER BY volume_5m DESC) AS rn
    FROM act WHERE volume_5m IS NOT NULL) WHERE rn <= 10 {group}),
base AS (SELECT {key} count(*) AS active_count, sum(volume_5m) AS vt, count(volume_5m) AS vk, count(*) FILTER (WHERE volume_5m > 0) AS vr,
    sum(CASE WHEN sell_volume_5m IS NOT NULL THEN buy_volume_5m END) AS b, sum(CASE WHEN buy_volume_5m IS NOT NULL THEN sell_volume_5m END) AS s,
    count(*) FILTER (WHERE buy_volume_5m IS NOT NULL AND sell_volume_5m IS NOT NULL) AS pk,
    sum(liquidity) AS lt, median(liquidity) AS lm, count(liquidity) AS lk FROM act {group}),
pulse AS (SELECT {key} active_count, round(vt, 4) AS volume_total, vk AS volume_known,
    round(CASE WHEN active_count > 0 THEN vk / active_count * CAST(100 AS DOUBLE) END, 4) AS volume_coverage_pct,
    round(CASE WHEN vk > 0 THEN vr / vk * CAST(100 AS DOUBLE) END, 4) AS volume_breadth_pct,
    round(CASE WHEN vt > 0 THEN top_volume / vt * 100 END, 4) AS volume_top10_share_pct,
    round(b, 4) AS buy_volume, round(s, 4) AS sell_volume, round(b - s, 4) AS net_volume,
    round(CASE WHEN b + s > 0 THEN b / (b + s) * 100 END, 4) AS buy_share_pct, pk AS pressure_known,
    round(CASE WHEN active_count > 0 THEN pk / active_count * CAST(100 AS DOUBLE) END, 4) AS pressure_coverage_pct,
    round(lt, 4) AS liquidity_total, round(lm, 4) AS liquidity_median, lk AS liquidity_known,
    round(CASE WHEN active_count > 0 THEN lk / active_count * CAST(100 AS DOUBLE) END, 4) AS liquidity_coverage_pct FROM base {join('top')})"""


SERIES = f"""pops AS (SELECT date_trunc('minute', observed_at) AS ts, mint, user_id % 20 <> 0 AS tracking_enabled,
    CASE WHEN buy_volume IS NOT NULL OR sell_volume IS NOT NULL THEN coalesce(buy_volume, 0) + coalesce(sell_volume, 0) END AS volume_5m,
    buy_volume AS buy_volume_5m, sell_volume AS sell_volume_5m, liquidity FROM snaps),
kept AS (SELECT min(ts) AS ts FROM pops GROUP BY epoch_us(ts) // 21600000000),
chosen AS (SELECT * FROM pops WHERE ts IN (SELECT ts FROM kept WHERE ts >= (SELECT max(ts) FROM kept) - INTERVAL '20' DAY)),
""" + pulse_sql("chosen", "ts")
SPACED = SERIES.replace(
    "kept AS (SELECT min(ts) AS ts FROM pops GROUP BY epoch_us(ts) // 21600000000)",
    """kept AS (SELECT min(ts) AS ts FROM pops UNION ALL
    SELECT min(p.ts) AS ts FROM kept k, pops p WHERE p.ts >= k.ts + INTERVAL '18420' SECOND HAVING min(p.ts) IS NOT NULL)""",
)
PULSE_OUT = "* REPLACE (epoch_us(ts) AS ts)"


def q_robust_log(spark, sf):
    tokens = fx.part_tokens(spark, sf)
    limits = ft.robust_log_range(tokens, "market_cap", *ft.MARKET_QUANTILES)
    return tidy(limits)


def sized(spark, sf):
    tokens = fx.part_tokens(spark, sf)
    limits = ft.robust_log_range(tokens, "market_cap", *ft.MARKET_QUANTILES)
    scored = ft.normalized_log(tokens, "market_cap", limits, "market_score")
    return scored.withColumn("size", ft.size_score(F.col("market_score")))


def q_normalized_log(spark, sf):
    return tidy(sized(spark, sf).select("mint", "market_score", "size"))


def q_freshness(spark, sf):
    rows = fx.table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") * 400).alias("age"))
    return tidy(rows.select("c_custkey", ft.freshness(F.col("age")).alias("freshness")))


def q_holder_scale(spark, sf):
    return tidy(ft.holder_scale(fx.part_tokens(spark, sf)).select("mint", "holder_score"))


def q_group_footprint(spark, sf):
    rows = sized(spark, sf).withColumn("launchpad", rk.launchpad_of())
    return tidy(ft.group_footprint(rows), 4)


def q_move_flags(spark, sf):
    return tidy(ft.move_flags(diff(spark, sf)))


def q_unit_hash(spark, sf):
    return tidy(fx.part_tokens(spark, sf).select("mint", ft.unit_hash(F.col("mint")).alias("unit")), 9)


FEED_FIELDS = {
    "name": ("'n' || CAST(seq AS STRING)", "NOT left_out"),
    "launchpad": ("launchpad", "true"),
    "market_cap": ("mcap_after", "true"),
    "liquidity": ("liquidity", "NOT left_out"),
    "holders": ("CAST(NULL AS INT)", "true"),
    "tracking_enabled": ("type <> 'token_retired'", "true"),
    "disabled_reason": (
        "CASE WHEN type = 'token_retired' AND reason IS NOT NULL THEN reason WHEN seq % 5 = 0 THEN 'token reason' END",
        "true",
    ),
}
FEED = """feed AS (SELECT *, type = 'token_retired' AND seq % 2 = 0 AS left_out FROM chg WHERE type <> 'other'),
newest AS (SELECT mint, """ + ", ".join(
    f"arg_max({{'v': {value}}}, seq) FILTER (WHERE {sets}) AS {name}" for name, (value, sets) in FEED_FIELDS.items()
) + " FROM feed GROUP BY mint)"
FEED_OUT = "SELECT coalesce(e.mint, p.mint) AS mint, " + ", ".join(
    f"{'round(' if name in ('market_cap', 'liquidity') else 'CAST('}CASE WHEN e.{name} IS NOT NULL THEN e.{name}.v ELSE p.{name} END"
    + {"market_cap": ", 6)", "liquidity": ", 6)", "holders": " AS BIGINT)", "tracking_enabled": " AS BOOLEAN)"}.get(name, " AS STRING)")
    + f" AS {name}"
    for name in FEED_FIELDS
) + " FROM prev p FULL JOIN newest e ON e.mint = p.mint"

SIGNALS = """signals AS (SELECT *, volume_before / mcap_before AS ratio_before, volume_after / mcap_after AS ratio_after FROM (
    SELECT seq, ts, mint, volume_after - volume_change AS volume_before, volume_after, mcap_after - mcap_change AS mcap_before, mcap_after
    FROM chg WHERE type = 'token_updated') WHERE volume_before >= 0 AND mcap_before > 0 AND mcap_after > 0 AND volume_after > volume_before
    AND volume_after / mcap_after > volume_before / mcap_before)"""
LOGS = "logs AS (SELECT log10(market_cap + 1) AS l FROM tok WHERE market_cap > 0),\nlim AS (SELECT quantile_cont(l, 0.05) AS low, quantile_cont(l, 0.995) AS high FROM logs)"
SCORED = LOGS + """,
scored AS (SELECT mint, CASE WHEN launchpad <> '' THEN launchpad ELSE 'unknown' END AS launchpad,
    CASE WHEN market_cap > 0 THEN greatest(0, least(1, (log10(market_cap + 1) - low) / (high - low))) END AS market_score FROM tok, lim),
sized AS (SELECT *, 4 + 50 * pow(market_score, CAST(1.45 AS DOUBLE)) AS size FROM scored)"""


def rank_sql(field, order, limit, where=""):
    return fx.with_ctes(("tok",), f"""SELECT rank, matched_count, mint, name, symbol, launchpad, round(market_cap, 6) AS market_cap, round(liquidity, 6) AS liquidity,
        CAST(holders AS BIGINT) AS holders, CAST(trades_5m AS BIGINT) AS trades_5m, CAST(traders_5m AS BIGINT) AS traders_5m, volume_5m, age_seconds, change_age_seconds
        FROM (SELECT *, row_number() OVER (ORDER BY {field} {order}, mint) AS rank, count(*) OVER () AS matched_count FROM tok
        WHERE coalesce(tracking_enabled, true) AND {field} IS NOT NULL {where}) WHERE rank <= {limit}""")


SEARCHED = """CASE WHEN lower(t.mint) LIKE '%' || {q} || '%' OR lower(t.symbol) LIKE '%' || {q} || '%' OR lower(t.name) LIKE '%' || {q} || '%' THEN 1 END = 1"""
SEARCH_ORDER = "(t.mint = {raw}) DESC, t.market_cap DESC NULLS LAST, lower(t.symbol || chr(1) || t.name || chr(1) || t.mint)"

QUERIES = {
    "projection_bucketed": (q_projection_bucketed, fx.with_ctes(("latest", "reg"), f"SELECT {PROJECTION_OUT} FROM ({_token_sql('latest', 'reg', T, 'r.tracking_enabled')})")),
    "current_projection": (q_current_projection, fx.with_ctes(("latest", "reg"), f"SELECT {PROJECTION_OUT} FROM ({_token_sql('latest', 'reg', T, 'r.tracking_enabled')})")),
    "visible_recent": (q_visible_recent, fx.with_ctes(("latest", "reg"), f"SELECT {PROJECTION_OUT} FROM ({_token_sql('latest', 'reg', T, VISIBLE)})")),
    "normalised_rows": (q_normalised_rows, fx.with_ctes(("latest", "reg"), f"""SELECT mint, launchpad, strftime(last_changed_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS last_changed_at,
        strftime(disabled_at, '%Y-%m-%dT%H:%M:%S+00:00') AS disabled_at, CAST(holders AS BIGINT) AS holders FROM ({_token_sql('latest', 'reg', T, VISIBLE)})""")),
    "token_lookup": (q_token_lookup, fx.with_ctes(("latest", "reg"), f"SELECT {PROJECTION_OUT} FROM ({_token_sql('latest', 'reg', T, VISIBLE)}) WHERE mint = '{LOOKED_UP}'")),
    "capabilities": (q_capabilities, fx.with_ctes(("tok",), "SELECT CASE WHEN launchpad <> '' THEN launchpad ELSE 'unknown' END AS value, count(*) AS active_tokens FROM tok WHERE coalesce(tracking_enabled, true) GROUP BY 1")),
    "rank_desc": (q_rank_desc, rank_sql("holders", "DESC", 20)),
    "rank_result": (q_rank_result, fx.with_ctes(("tok",), """SELECT 'market_cap' AS sort_by, 'asc' AS sort_order, 'BRAND#7' AS launchpad, max(m) AS matched_count, count(*) AS returned_count,
        string_agg(mint, ',' ORDER BY rank) AS mints FROM (SELECT mint, row_number() OVER (ORDER BY market_cap, mint) AS rank, count(*) OVER () AS m FROM tok
        WHERE coalesce(tracking_enabled, true) AND market_cap IS NOT NULL AND lower(launchpad) = 'brand#7') WHERE rank <= 7
        UNION ALL SELECT 'volume_5m', 'desc', NULL, 0, 0, ''""")),
    "rank_asc_filtered": (q_rank_asc_filtered, rank_sql("market_cap", "ASC", 10, "AND lower(launchpad) = 'brand#7'")),
    "search_tokens": (q_search_tokens, fx.with_ctes(("tok",), f"""SELECT rank, mint, symbol, name, round(market_cap, 6) AS market_cap FROM (
        SELECT t.*, row_number() OVER (ORDER BY {SEARCH_ORDER.format(raw="'Red'")}) AS rank FROM tok t WHERE t.tracking_enabled AND {SEARCHED.format(q="'red'")}) WHERE rank <= 8""")),
    "batch_search": (q_batch_search, fx.with_ctes(("tok",), f"""SELECT query_id, rank, mint, symbol, name, round(market_cap, 6) AS market_cap FROM (
        SELECT q.text AS query_id, t.*, row_number() OVER (PARTITION BY q.text ORDER BY {SEARCH_ORDER.format(raw='q.text')}) AS rank
        FROM tok t JOIN q ON {SEARCHED.format(q='lower(q.text)')} WHERE t.tracking_enabled) WHERE rank <= 8""",
        extra="q AS (SELECT p_name AS text FROM part UNION SELECT lower(p_type) FROM part)")),
    "population_diff": (q_population_diff, pop_sql(f"""SELECT type, mint, CASE WHEN type = 'token_retired' THEN disabled_reason END AS reason, round(token_market_cap, 6) AS token_market_cap,
        {', '.join(f"CASE WHEN type = 'token_updated' THEN round({f}_{k}, 6) END AS {f}_{k}" for f in DELTA for k in ('abs', 'pct'))} FROM diff""", DIFF)),
    "apply_feed": (q_apply_feed, fx.with_ctes(("latest", "reg", "chg"), FEED_OUT, NOW, 25, POPULATIONS + ",\n" + FEED)),
    "feed_round_trip": (q_feed_round_trip, pop_sql("SELECT mint, round(market_cap, 6) AS market_cap, source_updated_at FROM curr WHERE tracking_enabled")),
    "population_stats": (q_population_stats, fx.with_ctes(("tok",), "SELECT count(*) AS active, count(DISTINCT CASE WHEN launchpad <> '' THEN launchpad ELSE 'unknown' END) AS launchpads FROM tok WHERE tracking_enabled")),
    "changed_count": (q_changed_count, fx.with_ctes(("chg",), f"SELECT count(DISTINCT mint) AS changed FROM chg WHERE ts >= TIMESTAMP '{END}' - INTERVAL '15' DAY")),
    "volume_signals": (q_volume_signals, fx.with_ctes(("chg",), """SELECT seq, mint, round(volume_before, 6) AS volume_before, round(volume_after, 6) AS volume_after,
        round(mcap_before, 6) AS mcap_before, round(mcap_after, 6) AS mcap_after, round(ratio_before, 6) AS ratio_before, round(ratio_after, 6) AS ratio_after FROM signals""", extra=SIGNALS)),
    "top_volume": (q_top_volume, fx.with_ctes(("chg",), f"""SELECT mint, epoch_us(ts) AS ts_us, round(b.volume_before, 6) AS volume_before, round(b.mcap_before, 6) AS mcap_before,
        round(b.ratio_before, 6) AS ratio_before, round(a.volume_after, 6) AS volume_after, round(a.mcap_after, 6) AS mcap_after, round(a.ratio_after, 6) AS ratio_after,
        round(a.volume_after - b.volume_before, 6) AS volume_change, round(a.ratio_after - b.ratio_before, 6) AS ratio_change, rank FROM (
        SELECT *, row_number() OVER (ORDER BY a.ratio_after - b.ratio_before DESC, a.volume_after - b.volume_before DESC, mint) AS rank FROM (
        SELECT mint, max(ts) AS ts, arg_min(s, (ts, seq)) AS b, arg_max(s, (ts, seq)) AS a FROM signals s WHERE ts >= TIMESTAMP '{END}' - INTERVAL '15' DAY GROUP BY mint)
        WHERE a.volume_after > b.volume_before AND a.ratio_after > b.ratio_before) WHERE rank <= 5""", extra=SIGNALS)),
    "market_pulse": (q_market_pulse, pop_sql("SELECT * FROM pulse", pulse_sql("curr"))),
    "market_pulse_by_group": (q_market_pulse_by_group, pop_sql("SELECT * FROM pulse", pulse_sql("curr", "launchpad"))),
    "pulse_series": (q_pulse_series, fx.with_ctes(("snaps",), "SELECT epoch_us(ts) AS ts_us, * EXCLUDE (ts) FROM pulse", extra=SERIES)),
    "pulse_series_spaced": (q_pulse_series_spaced, fx.with_ctes(("snaps",), "SELECT epoch_us(ts) AS ts_us, * EXCLUDE (ts) FROM pulse", extra=SPACED).replace("WITH ", "WITH RECURSIVE ", 1)),
    "robust_log": (q_robust_log, fx.with_ctes(("tok",), "SELECT round(low, 6) AS low, round(CASE WHEN high > low THEN high ELSE low + 1 END, 6) AS high FROM lim", extra=LOGS)),
    "normalized_log": (q_normalized_log, fx.with_ctes(("tok",), "SELECT mint, round(market_score, 6) AS market_score, round(size, 6) AS size FROM sized", extra=SCORED)),
    "freshness": (q_freshness, """SELECT c_custkey, round(CASE WHEN c_acctbal * 400 >= 2592000 THEN 0 WHEN c_acctbal * 400 >= 0
        THEN greatest(0, least(1, 1 - ln(1 + c_acctbal * 400 / 21600) / ln(CAST(121 AS DOUBLE)))) END, 6) AS freshness FROM customer"""),
    "holder_scale": (q_holder_scale, fx.with_ctes(("tok",), """SELECT mint, round(CASE WHEN holders > 0 THEN greatest(0, least(1, log10(CAST(holders AS DOUBLE) + 1) /
        (SELECT quantile_cont(log10(CAST(holders AS DOUBLE) + 1), 0.95) FROM tok WHERE holders > 0))) END, 6) AS holder_score FROM tok""")),
    "group_footprint": (q_group_footprint, fx.with_ctes(("tok",), """SELECT launchpad, count(*) AS members, round(greatest(CAST(88 AS DOUBLE),
        sqrt((sum(pi() * pow(coalesce(size, 4) + 5, 2)) + pi() * 46 * 46) / (pi() * CAST(0.64 AS DOUBLE))) + 30), 4) AS radius FROM sized GROUP BY launchpad""", extra=SCORED)),
    "move_flags": (q_move_flags, pop_sql("""SELECT mint, round(m, 6) AS move, abs(m) >= CAST(0.03 AS DOUBLE) AS visible, abs(m) >= CAST(0.1 AS DOUBLE) AS strong, CAST(sign(m) AS BIGINT) AS direction
        FROM (SELECT mint, (c_mcap - p_mcap) / p_mcap AS m FROM diff WHERE type = 'token_updated' AND c_mcap > 0 AND p_mcap > 0)""", DIFF)),
    "unit_hash": (q_unit_hash, fx.with_ctes(("tok",), "SELECT mint, round(CAST('0x' || substr(md5(mint), 1, 8) AS BIGINT) / CAST(4294967295 AS DOUBLE), 9) AS unit FROM tok")),
}
