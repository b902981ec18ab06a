"""Registered queries: sources, admission, ingest and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.coerce import text_of
from tidemark.operators import ingest, registry as reg
from tidemark.plans import fixtures as fx
from tidemark.plans.common import tidy
from tidemark.plans.cycle import ingest_batch
from tidemark.session import shared_dir
from tidemark.sources import candidates as cand, payload as pl, tables
from tidemark.streaming.collector import process_batch

NOW = fx.FULL
T = f"TIMESTAMP '{NOW}'"
MINT = fx.MINT

RECENT_BODY = f"""'[{{"id":"' || {MINT} || '"}},{{"id":""}},{{"id":5}},7,{{"id":"R' || CAST(event_id % 50 AS STRING) || '"}}]'"""
POOL_BODY = """'[{"token_x":{"address":"P' || CAST(l_partkey AS STRING) || '"},"token_y":' ||
    CASE WHEN l_returnflag = 'N' THEN 'null' ELSE '{"address":"S' || CAST(l_suppkey AS STRING) || '"}' END || '}]'"""
MESSAGE_BODY = f"""'{{"mint":' || CASE WHEN event_type = 'error' THEN CAST(event_id AS STRING) WHEN event_type = 'view' THEN '""'
    ELSE '"' || {MINT} || '"' END || '}}'"""


def raw(spark, sf, table, body):
    frame = fx.events_k(spark, sf) if table == "events" else fx.table(spark, sf, table)
    used = ["event_id", "event_type", "user_id"] if table == "events" else ["l_partkey", "l_suppkey", "l_returnflag"]
    return fx.dealt(frame.select(*used)).selectExpr(f"{body} AS body")


def sources(spark, sf):
    return cand.union_sources(
        {
            "recent": cand.candidates_from_recent(raw(spark, sf, "events", RECENT_BODY)),
            "pools": cand.candidates_from_pools(raw(spark, sf, "lineitem", POOL_BODY)),
            "messages": cand.candidates_from_messages(raw(spark, sf, "events", MESSAGE_BODY)),
        }
    )


SOURCES = f"""cands AS (
    SELECT 'recent' AS source, 0 AS source_order, {MINT} AS mint FROM events_k
    UNION ALL SELECT 'recent', 0, 'R' || CAST(event_id % 50 AS STRING) FROM events_k
    UNION ALL SELECT 'pools', 1, 'P' || CAST(l_partkey AS STRING) FROM lineitem
    UNION ALL SELECT 'pools', 1, 'S' || CAST(l_suppkey AS STRING) FROM lineitem WHERE l_returnflag <> 'N'
    UNION ALL SELECT 'messages', 2, {MINT} FROM events_k WHERE event_type NOT IN ('error', 'view'))"""


def q_active_keys(spark, sf):
    return reg.active_by_priority(fx.registry(spark, sf, NOW))


def q_pool_candidates(spark, sf):
    found = cand.candidates_from_pools(raw(spark, sf, "lineitem", POOL_BODY))
    return found.groupBy("mint").agg(F.count("*").alias("occurrences"))


def q_recent_candidates(spark, sf):
    found = cand.candidates_from_recent(raw(spark, sf, "events", RECENT_BODY))
    return found.groupBy("mint").agg(F.count("*").alias("occurrences"))


def q_message_candidates(spark, sf):
    found = cand.candidates_from_messages(raw(spark, sf, "events", MESSAGE_BODY))
    return found.groupBy("mint").agg(F.count("*").alias("occurrences"))


def q_source_union(spark, sf):
    return sources(spark, sf).groupBy("source").agg(
        F.count("*").alias("occurrences"), F.count_distinct("mint").alias("keys")
    )


def q_key_audit(spark, sf):
    lines = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "CASE WHEN l_discount = 0 THEN NULL ELSE l_linenumber END AS l_linenumber"
    )
    return tidy(reg.audit_keys(lines, ["l_orderkey", "l_linenumber"]))


def q_admit_new(spark, sf):
    return ingest.admit(sources(spark, sf), fx.known_registry(spark, sf)).select(
        "mint", "tracking_enabled", F.col("priority").cast("bigint").alias("priority"), "name"
    )


def q_discovery_tick(spark, sf):
    return ingest.discovery_tick(sources(spark, sf), fx.known_registry(spark, sf), ["recent", "pools", "messages", "silent"])


def versions(spark, sf):
    return ingest.collapse_versions(fx.polls(spark, sf))


def _payload_seq(df):
    """The payload as plain numbers: which arrival it came from and its measure."""
    return df.withColumns(
        {
            "payload_r": text_of(F.col("payload"), "$.r").cast("bigint"),
            "payload_mcap": text_of(F.col("payload"), "$.mcap").cast("double"),
        }
    ).drop("payload")


def q_collapse_versions(spark, sf):
    return tidy(_payload_seq(versions(spark, sf)))


def q_newer_versions(spark, sf):
    newer = ingest.newer_versions(versions(spark, sf), fx.known_registry(spark, sf))
    return tidy(newer.select("mint", "updated_at", "observed_at", "last_polled_at"))


def q_append_snapshots(spark, sf):
    newer = ingest.newer_versions(versions(spark, sf), fx.known_registry(spark, sf))
    return tidy(_payload_seq(ingest.append_snapshots(newer, fx.known_snapshots(spark, sf), fx.polls(spark, sf))))


def folded(spark, sf):
    return ingest.fold_versions(ingest.tag_versions(versions(spark, sf), fx.known_registry(spark, sf)))


def q_enrich_registry(spark, sf):
    rows = ingest.enrich_registry(fx.known_registry(spark, sf), folded(spark, sf))
    return tidy(
        rows.select(
            "mint", "name", "symbol", "decimals", "token_program", "created_at", "first_pool_id",
            "first_pool_created_at", "mint_authority_disabled", "tracking_enabled", "priority",
        )
    )


def q_merge_poll_facts(spark, sf):
    rows = ingest.merge_poll_facts(fx.known_registry(spark, sf), folded(spark, sf))
    return tidy(rows.select("mint", "first_observed_at", "last_polled_at", "last_changed_at", "source_updated_at"))


def batch(spark, sf):
    return ingest_batch(fx.polls(spark, sf), fx.known_registry(spark, sf), fx.known_snapshots(spark, sf))


def q_ingest_batch(spark, sf):
    rows = batch(spark, sf).registry
    return tidy(rows.select("mint", "name", "tracking_enabled", "first_observed_at", "last_polled_at", "last_changed_at"))


def q_stored_state(spark, sf):
    """Two batches through the collector into a store, the second one repeated; then the store is read back."""
    root = shared_dir(spark)
    tables.init_tables(spark, root)
    polls, half = fx.polls(spark, sf), F.lit(fx.KNOWN_UNTIL).cast("timestamp")
    early, late = polls.where(F.col("observed_at") <= half), polls.where(F.col("observed_at") > half)
    for batch, rows in ((0, early), (1, late), (1, late)):
        process_batch(spark, root, rows, batch, writer="query")
    history = tables.read_snapshots(spark, root).groupBy("mint").agg(F.count("*").alias("snapshots"), F.max("observed_at").alias("newest"))
    state = tables.read_registry(spark, root).select("mint", "name", "first_observed_at", "last_polled_at", "last_changed_at")
    return tidy(state.join(history, "mint", "left"))


def q_store_summary(spark, sf):
    return batch(spark, sf).summary


def q_expire_snapshots(spark, sf):
    rows = fx.snapshots(spark, sf, NOW).select("mint", "observed_at", "seq")
    return tidy(ingest.expire_snapshots(rows, fx.KNOWN_UNTIL, hours=24))


def q_expired_count(spark, sf):
    return ingest.expired_count(fx.snapshots(spark, sf, NOW), fx.KNOWN_UNTIL, hours=24)


def q_payload_lifecycle(spark, sf):
    return tidy(pl.lifecycle_view(fx.payload_snapshots(spark, sf, NOW)))


def q_payload_current(spark, sf):
    return tidy(pl.current_view(fx.payload_snapshots(spark, sf, NOW)))


def q_payload_history(spark, sf):
    rows = pl.history_view(fx.payload_snapshots(spark, sf, NOW))
    stats = {f"stat_{name}": F.try_element_at("stats_1h", F.lit(name)) for name in fx.STATS}
    return tidy(rows.withColumns({**stats, "stats": F.size("stats_1h")}).drop("stats_1h"))


VERSION_FACTS = """facts AS (SELECT v.mint, max(v.last_polled_at) AS polled_at,
    min(CASE WHEN n.mint IS NOT NULL THEN v.observed_at END) AS first_new_at,
    arg_max(CASE WHEN n.mint IS NOT NULL THEN v.observed_at END, v.source_time) FILTER (WHERE n.mint IS NOT NULL) AS newest_at,
    arg_max(v.updated_at, v.source_time) FILTER (WHERE n.mint IS NOT NULL) AS newest_updated_at,
    arg_max({'e': v.event_id, 'u': v.user_id, 't': v.source_time}, v.source_time) AS top
    FROM versions v LEFT JOIN newer n ON n.mint = v.mint AND n.updated_at = v.updated_at GROUP BY v.mint)"""
ISO = "%Y-%m-%dT%H:%M:%S.%fZ"
MERGED = f"""epoch_us(coalesce(k.first_observed_at, f.first_new_at)) AS first_observed_at_us,
    epoch_us(greatest(k.last_polled_at, f.polled_at)) AS last_polled_at_us,
    epoch_us(coalesce(f.newest_at, k.last_changed_at)) AS last_changed_at_us"""


def sql(needed, body, extra=""):
    return fx.with_ctes(needed, body, extra=extra)


QUERIES = {
    "active_keys": (q_active_keys, sql(("reg",), "SELECT mint FROM reg WHERE tracking_enabled")),
    "recent_candidates": (q_recent_candidates, sql(("events_k",), "SELECT mint, count(*) AS occurrences FROM cands WHERE source = 'recent' GROUP BY mint", SOURCES)),
    "pool_candidates": (q_pool_candidates, sql(("events_k",), "SELECT mint, count(*) AS occurrences FROM cands WHERE source = 'pools' GROUP BY mint", SOURCES)),
    "message_candidates": (q_message_candidates, sql(("events_k",), "SELECT mint, count(*) AS occurrences FROM cands WHERE source = 'messages' GROUP BY mint", SOURCES)),
    "source_union": (q_source_union, sql(("events_k",), "SELECT source, count(*) AS occurrences, count(DISTINCT mint) AS keys FROM cands GROUP BY source", SOURCES)),
    "key_audit": (q_key_audit, """WITH l AS (SELECT l_orderkey, CASE WHEN l_discount = 0 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS l_linenumber FROM lineitem)
        SELECT l_orderkey, l_linenumber, count(*) AS rows, l_linenumber IS NULL AS has_null FROM l GROUP BY 1, 2 HAVING count(*) > 1 OR l_linenumber IS NULL"""),
    "admit_new": (q_admit_new, sql(("known",), """SELECT mint, tracking_enabled, CAST(1 AS BIGINT) AS priority, name FROM known
        UNION ALL SELECT DISTINCT mint, true, CAST(1 AS BIGINT), CAST(NULL AS STRING) FROM cands WHERE mint NOT IN (SELECT mint FROM known)""", SOURCES)),
    "discovery_tick": (q_discovery_tick, sql(("known",), """SELECT c.source, count(*) AS candidate_occurrences, count(DISTINCT c.mint) AS unique_candidates,
        count(DISTINCT CASE WHEN c.source_order = f.o THEN c.mint END) AS new_keys
        FROM cands c LEFT JOIN (SELECT mint, min(source_order) AS o FROM cands WHERE mint NOT IN (SELECT mint FROM known) GROUP BY mint) f ON f.mint = c.mint GROUP BY c.source
        UNION ALL SELECT 'silent', 0, 0, 0""", SOURCES)),
    "collapse_versions": (q_collapse_versions, sql(("versions",), """SELECT mint, updated_at, epoch_us(source_time) AS source_time_us, epoch_us(observed_at) AS observed_at_us,
        epoch_us(last_polled_at) AS last_polled_at_us, arrival_seq, CAST(0 AS BIGINT) AS payload_r,
        (SELECT round(e.value, 6) FROM events_k e WHERE e.event_id = v.event_id) AS payload_mcap FROM versions v""")),
    "newer_versions": (q_newer_versions, sql(("newer",), "SELECT mint, updated_at, epoch_us(observed_at) AS observed_at_us, epoch_us(last_polled_at) AS last_polled_at_us FROM newer")),
    "append_snapshots": (q_append_snapshots, sql(("newer",), """SELECT n.mint, epoch_us(n.observed_at) AS observed_at_us, CAST(0 AS BIGINT) AS payload_r, round(e.value, 6) AS payload_mcap
        FROM newer n JOIN events_k e ON e.event_id = n.event_id WHERE e.event_type <> 'purchase'""")),
    "enrich_registry": (q_enrich_registry, sql(("newer",), f"""SELECT mint, name, symbol, decimals, token_program, epoch_us(created_at) AS created_at_us, first_pool_id,
        epoch_us(first_pool_created_at) AS first_pool_created_at_us, mint_authority_disabled, tracking_enabled, CAST(1 AS BIGINT) AS priority FROM (
        SELECT coalesce(k.mint, f.mint) AS mint, coalesce(k.name, 'polled ' || CAST(f.top.u AS STRING)) AS name,
        CASE WHEN k.name IS NULL THEN 'S' || CAST(f.top.e % 7 AS STRING) END AS symbol,
        CASE WHEN k.name IS NULL THEN f.top.e % 9 END AS decimals, CASE WHEN k.name IS NULL THEN 'prog' END AS token_program,
        CASE WHEN k.name IS NULL THEN f.top.t END AS created_at,
        CASE WHEN k.name IS NULL AND f.top.e % 2 = 0 THEN 'F' || CAST(f.top.e AS STRING) END AS first_pool_id,
        CASE WHEN k.name IS NULL AND f.top.e % 2 = 0 THEN f.top.t END AS first_pool_created_at,
        CASE WHEN k.name IS NULL AND f.top.e % 3 = 0 THEN true END AS mint_authority_disabled,
        coalesce(k.tracking_enabled, true) AS tracking_enabled
        FROM known k FULL JOIN facts f ON f.mint = k.mint)""", VERSION_FACTS)),
    "merge_poll_facts": (q_merge_poll_facts, sql(("newer",), f"""SELECT k.mint, {MERGED}, coalesce(f.newest_updated_at, strftime(k.held, '{ISO}')) AS source_updated_at
        FROM known k LEFT JOIN facts f ON f.mint = k.mint""", VERSION_FACTS)),
    "ingest_batch": (q_ingest_batch, sql(("newer",), f"""SELECT f.mint, coalesce(k.name, 'polled ' || CAST(f.top.u AS STRING)) AS name,
        coalesce(k.tracking_enabled, true) AS tracking_enabled, {MERGED} FROM facts f LEFT JOIN known k ON k.mint = f.mint""", VERSION_FACTS)),
    "stored_state": (q_stored_state, sql(("polls",), """SELECT id AS mint, 'polled ' || CAST(user_id AS STRING) AS name, epoch_us(min(source_time)) AS first_observed_at_us,
        epoch_us(max(observed_at)) AS last_polled_at_us, epoch_us(max(source_time)) AS last_changed_at_us, count(DISTINCT source_time) AS snapshots,
        epoch_us(max(source_time)) AS newest_us FROM polls GROUP BY id, user_id""")),
    "store_summary": (q_store_summary, sql(("newer",), """SELECT (SELECT count(*) FROM facts f WHERE f.mint NOT IN (SELECT mint FROM known WHERE name IS NOT NULL)) AS enriched_keys,
        (SELECT count(*) FROM newer) AS offered_snapshots,
        (SELECT count(*) FROM newer n JOIN events_k e ON e.event_id = n.event_id WHERE e.event_type <> 'purchase') AS added_snapshots""", VERSION_FACTS)),
    "expire_snapshots": (q_expire_snapshots, sql(("snaps",), f"SELECT mint, epoch_us(observed_at) AS observed_at_us, seq FROM snaps WHERE observed_at >= TIMESTAMP '{fx.KNOWN_UNTIL}' - INTERVAL '24' HOUR")),
    "expired_count": (q_expired_count, sql(("snaps",), f"SELECT count(*) AS deleted FROM snaps WHERE observed_at < TIMESTAMP '{fx.KNOWN_UNTIL}' - INTERVAL '24' HOUR")),
    "payload_lifecycle": (q_payload_lifecycle, sql(("snaps",), """SELECT mint, epoch_us(observed_at) AS observed_at_us, round(mcap, 6) AS mcap, round(liquidity, 6) AS liquidity,
        CAST(holder_count AS DOUBLE) AS holders, mcap IS NOT NULL OR liquidity IS NOT NULL AS has_economic, round(mcap, 6) AS scan_mcap, round(liquidity, 6) AS scan_liquidity FROM snaps""")),
    "payload_current": (q_payload_current, sql(("snaps",), """SELECT mint, epoch_us(observed_at) AS observed_at_us, name, symbol, launchpad, round(mcap, 6) AS market_cap,
        round(liquidity, 6) AS liquidity, CAST(holder_count AS BIGINT) AS holders,
        CASE WHEN num_buys IS NOT NULL OR num_sells IS NOT NULL THEN CAST(coalesce(num_buys, 0) + coalesce(num_sells, 0) AS BIGINT) END AS trades_5m,
        CAST(num_traders AS BIGINT) AS traders_5m, round(buy_volume, 6) AS buy_volume_5m, round(sell_volume, 6) AS sell_volume_5m,
        round(CASE WHEN buy_volume IS NOT NULL OR sell_volume IS NOT NULL THEN coalesce(buy_volume, 0) + coalesce(sell_volume, 0) END, 6) AS volume_5m FROM snaps""")),
    "payload_history": (q_payload_history, sql(("snaps",), f"""SELECT mint, epoch_us(observed_at) AS observed_at_us, round(mcap, 6) AS market_cap, round(liquidity, 6) AS liquidity,
        CAST(holder_count AS DOUBLE) AS holders, round(organic_score, 6) AS organic_score, dev_mints, round(dev_balance_pct, 6) AS dev_balance_pct,
        round(top_holders_pct, 6) AS top_holders_pct, {', '.join(f'round(CAST({n} AS DOUBLE), 6) AS stat_{n}' for n in fx.STATS)},
        CAST({' + '.join(f'CAST({n} IS NOT NULL AS INT)' for n in fx.STATS)} AS BIGINT) AS stats FROM snaps""")),
}
