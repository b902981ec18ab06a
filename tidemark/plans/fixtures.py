"""Input tables of the registered queries, derived from the driver's base tables.

Row-wise column expressions are SQL text shared by both engines; everything else exists twice, as DataFrame code here
and as CTE text in ``ctes``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import schemas
from tidemark.functions.coerce import instant

FULL = "2024-01-31 00:00:00"
BEFORE = "2024-01-29 00:00:00"
KNOWN_UNTIL = "2024-01-10 00:00:00"

MINT = "'M' || lpad(CAST(user_id AS STRING), 6, '0')"

SNAPSHOT_COLUMNS = (
    f"{MINT} AS mint",
    "user_id",
    "ts AS observed_at",
    "event_id AS seq",
    "event_type AS launchpad",
    "CASE WHEN user_id % 10 = 3 OR event_id % 7 = 0 THEN NULL ELSE value * 100 END AS mcap",
    "CASE WHEN user_id % 10 = 3 OR event_id % 11 = 0 THEN NULL ELSE k * CAST(50 AS DOUBLE) END AS liquidity",
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 40 AS INT) END AS holder_count",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 17 AS INT) END AS num_buys",
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 9 AS INT) END AS num_sells",
    "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 23 AS INT) END AS num_traders",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 2 END AS buy_volume",
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS sell_volume",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS buy_organic_volume",
    "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(k AS DOUBLE) / 2 END AS sell_organic_volume",
    "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS organic_score",
    "CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(user_id % 5 AS DOUBLE) END AS dev_mints",
    "CASE WHEN event_id % 8 = 1 THEN NULL ELSE value / 8 END AS dev_balance_pct",
    "CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(k AS DOUBLE) / 2 END AS top_holders_pct",
    "CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'name ' || CAST(user_id AS STRING) END AS name",
    "CASE WHEN event_id % 4 = 1 THEN NULL ELSE 'S' || CAST(user_id % 7 AS STRING) END AS symbol",
)

# Row-wise change events: the values before are implied by the reported changes.
CHANGE_COLUMNS = (
    "event_id AS seq",
    "ts",
    "CASE event_type WHEN 'view' THEN 'token_updated' WHEN 'click' THEN 'token_updated' "
    "WHEN 'signup' THEN 'token_added' WHEN 'purchase' THEN 'token_retired' ELSE 'other' END AS type",
    f"{MINT} AS mint",
    "'pad' || CAST(user_id % 4 AS STRING) AS launchpad",
    "CASE WHEN event_id % 9 = 0 THEN NULL ELSE value * 10 END AS volume_after",
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS volume_change",
    "CASE WHEN event_id % 8 = 0 THEN NULL ELSE 1000 + value END AS mcap_after",
    "CAST(event_id % 41 - 20 AS DOUBLE) AS mcap_change",
    "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(k AS DOUBLE) * 5 END AS liquidity",
    "CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'reason ' || CAST(event_id % 3 AS STRING) END AS reason",
)

PART_COLUMNS = (
    "'P' || lpad(CAST(p_partkey AS STRING), 8, '0') AS mint",
    "p_name AS name",
    "p_type AS symbol",
    "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END AS launchpad",
    "CASE WHEN p_partkey % 10 = 5 THEN NULL ELSE p_partkey % 10 <> 0 END AS tracking_enabled",
    "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS market_cap",
    "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) * 3 END AS liquidity",
    "p_size AS holders",
    "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 17 AS INT) END AS trades_5m",
    "CAST(p_partkey % 19 AS INT) AS traders_5m",
    "CAST(p_partkey % 23 AS DOUBLE) AS volume_5m",
    "CAST(p_partkey * 60 AS DOUBLE) AS age_seconds",
    "CAST(p_size * 7 AS DOUBLE) AS change_age_seconds",
)

TELEMETRY_COLUMNS = (
    "event_id AS seq",
    "ts AS received_at",
    "CASE event_type WHEN 'view' THEN 'search_lane_tick' WHEN 'click' THEN 'discovery_tick' "
    "WHEN 'purchase' THEN 'search_flush' WHEN 'signup' THEN 'lifecycle_tick' ELSE 'unknown' END AS type",
    "'at' || CAST(event_id - event_id % 4 AS STRING) AS at_text",
    "CASE WHEN event_type = 'click' THEN 'source' || CAST(user_id % 5 AS STRING) END AS source",
    "CASE WHEN event_type = 'view' THEN 'lane' || CAST(user_id % 45 AS STRING) END AS lane",
    "CAST(k AS DOUBLE) AS rpm60",
    "CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS latency_ms",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) END AS response_items",
    "CAST(event_id % 7 AS DOUBLE) AS new_mints",
    "CAST(event_id % 500 AS DOUBLE) AS polled_tokens",
    "CAST(event_id % 300 AS DOUBLE) AS source_versions",
    "CAST(event_id % 200 AS DOUBLE) AS new_snapshots",
    "CAST(event_id % 3 AS DOUBLE) AS affected_count",
)

TELEMETRY_BODY = """'{"type":"' || type || '","at":"' || CASE WHEN seq % 19 = 0 THEN '' ELSE at_text END || '"'
|| CASE type
   WHEN 'search_lane_tick' THEN ',"lane":"' || lane || '","status":200,"requested":100,"received":null,"rpm60":1'
   WHEN 'discovery_tick' THEN ',"source":"' || source || '","status":200,"response_items":3,"candidate_occurrences":3,"unique_candidates":2,"new_mints":1'
   WHEN 'search_flush' THEN ',"polled_tokens":5,"source_versions":3,"new_snapshots":2,"write_ms":7'
   WHEN 'lifecycle_tick' THEN ',"apply":true,"affected_count":1,"breakdown":{"rule1":1},"active_remaining":9'
   ELSE '' END
|| CASE WHEN seq % 11 = 0 THEN '' WHEN type IN ('search_lane_tick', 'discovery_tick') THEN ',"latency_ms":12'
   WHEN type = 'search_flush' THEN ',"queue_size":0' ELSE ',"duration_ms":4' END
|| CASE WHEN seq % 13 = 0 THEN ',"detail":[{"x":{"API_Key":1}}]' ELSE '' END
|| CASE WHEN seq % 17 = 0 THEN ',"note":"{, secret : x}"' ELSE '' END || '}'"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows dealt over the shuffle partitions, at every size alike, before bodies are derived from them that are many
    times their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def events_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "CAST(ts AS TIMESTAMP) AS ts",
        "user_id",
        "event_type",
        "value",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
    )


def snapshots(spark: SparkSession, sf_dir: str, as_of: str) -> DataFrame:
    return events_k(spark, sf_dir).where(F.col("ts") <= instant(as_of)).selectExpr(*SNAPSHOT_COLUMNS)


def payload_snapshots(spark: SparkSession, sf_dir: str, as_of: str) -> DataFrame:
    """The same history with JSON payloads: numbers partly as text, blanks for keys ending in 3, extra keys."""

    def number(key: str, column: str) -> str:
        return f"""CASE WHEN {column} IS NULL THEN NULL WHEN seq % 4 = 0 THEN '"{key}":" ' || CAST({column} AS STRING) || ' "'
                   ELSE '"{key}":' || CAST({column} AS STRING) END"""

    def whole(key: str, column: str) -> str:
        return f"""'"{key}":' || CAST({column} AS STRING)"""

    def text(key: str, column: str) -> str:
        return f"""'"{key}":"' || {column} || '"'"""

    blank = """CASE WHEN user_id % 10 = 3 THEN '"mcap":" ","liquidity":""' END"""
    stats5m = ", ".join(
        [whole("numBuys", "num_buys"), whole("numSells", "num_sells"), whole("numTraders", "num_traders"),
         number("buyVolume", "buy_volume"), number("sellVolume", "sell_volume")]
    )
    stats1h = ", ".join(
        [number("buyVolume", "buy_volume"), number("sellVolume", "sell_volume"),
         number("buyOrganicVolume", "buy_organic_volume"), number("sellOrganicVolume", "sell_organic_volume"),
         whole("numBuys", "num_buys"), whole("numSells", "num_sells"), """'"flag":true,"nested":{"a":1}'"""]
    )
    audit = ", ".join(
        [number("devMints", "dev_mints"), number("devBalancePercentage", "dev_balance_pct"),
         number("topHoldersPercentage", "top_holders_pct")]
    )
    body = f"""'{{' || concat_ws(',', {blank}, {number('mcap', 'mcap')}, {number('liquidity', 'liquidity')},
        {whole('holderCount', 'holder_count')}, {number('organicScore', 'organic_score')}, {text('launchpad', 'launchpad')},
        {text('name', 'name')}, {text('symbol', 'symbol')}, '"id":"' || mint || '"',
        '"stats5m":{{' || concat_ws(',', {stats5m}) || '}}', '"stats1h":{{' || concat_ws(',', {stats1h}) || '}}',
        '"audit":{{' || concat_ws(',', {audit}) || '}}') || '}}'"""
    return dealt(snapshots(spark, sf_dir, as_of)).selectExpr("mint", "observed_at", f"parse_json({body}) AS payload")


def lifecycle_rows(spark: SparkSession, sf_dir: str, as_of: str) -> DataFrame:
    """The slim typed layer of ``lifecycle_view``."""
    return snapshots(spark, sf_dir, as_of).selectExpr(
        "mint",
        "observed_at",
        "mcap",
        "liquidity",
        "CAST(holder_count AS DOUBLE) AS holders",
        "mcap IS NOT NULL OR liquidity IS NOT NULL AS has_economic",
        "mcap AS scan_mcap",
        "liquidity AS scan_liquidity",
    )


def current_rows(spark: SparkSession, sf_dir: str, as_of: str) -> DataFrame:
    """The slim typed layer of ``current_view``."""
    return snapshots(spark, sf_dir, as_of).selectExpr(
        "mint",
        "observed_at",
        "name",
        "symbol",
        "launchpad",
        "mcap AS market_cap",
        "liquidity",
        "holder_count AS holders",
        "CASE WHEN num_buys IS NOT NULL OR num_sells IS NOT NULL THEN coalesce(num_buys, 0) + coalesce(num_sells, 0) END AS trades_5m",
        "num_traders AS traders_5m",
        "buy_volume AS buy_volume_5m",
        "sell_volume AS sell_volume_5m",
        "CASE WHEN buy_volume IS NOT NULL OR sell_volume IS NOT NULL THEN coalesce(buy_volume, 0) + coalesce(sell_volume, 0) END AS volume_5m",
    )


STATS = ("buy_volume", "sell_volume", "buy_organic_volume", "sell_organic_volume", "num_buys", "num_sells")


def history_rows(spark: SparkSession, sf_dir: str, as_of: str) -> DataFrame:
    """The slim typed layer of ``history_view``."""
    stats = ", ".join(f"'{name}', CAST({name} AS DOUBLE)" for name in STATS)
    return snapshots(spark, sf_dir, as_of).selectExpr(
        "mint",
        "observed_at",
        "mcap AS market_cap",
        "liquidity",
        "CAST(holder_count AS DOUBLE) AS holders",
        "organic_score",
        "dev_mints",
        "dev_balance_pct",
        "top_holders_pct",
        f"map_filter(map({stats}), (name, v) -> v IS NOT NULL) AS stats_1h",
    )


def as_registry(rows: DataFrame) -> DataFrame:
    """Registry schema with NULL (priority: 1) for the columns the rows do not have."""
    known = set(rows.columns)
    missing = {"priority": F.lit(1), "tracking_enabled": F.lit(True)}
    return rows.select(
        *[
            (F.col(f.name) if f.name in known else missing.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
            for f in schemas.REGISTRY.fields
        ]
    )


def registry(spark: SparkSession, sf_dir: str, as_of: str, inactive_every: int = 20) -> DataFrame:
    """One row per key seen by ``as_of``; created up to eleven hours before the first snapshot."""
    seen = snapshots(spark, sf_dir, as_of).groupBy("mint", "user_id").agg(
        F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_changed_at")
    )
    now = instant(as_of)
    active = F.col("user_id") % inactive_every != 0
    user = F.col("user_id")
    return as_registry(
        seen.withColumns(
            {
                "tracking_enabled": active,
                "created_at": F.col("first_observed_at") - F.expr("make_dt_interval(0, CAST(user_id % 12 AS INT))"),
                "last_polled_at": now - F.expr("make_dt_interval(0, 0, 0, user_id % 90)"),
                "name": F.when(user % 3 != 0, F.concat(F.lit("known "), user.cast("string"))),
                "source_updated_at": F.concat(F.lit("v"), F.unix_micros("last_changed_at").cast("string")),
                "disabled_at": F.when(~active & (user % 40 != 0), now - F.expr("make_dt_interval(0, 0, CAST(user_id % 60 AS INT))")),
                "disabled_reason": F.when(~active, F.lit("earlier")),
            }
        )
    )


def spread_registry(spark: SparkSession, sf_dir: str, as_of: str) -> DataFrame:
    """Registry whose keys were created over the last two days, so that every rule has eligible keys at ``as_of``."""
    rows = registry(spark, sf_dir, as_of).withColumn("_user", F.expr("CAST(substring(mint, 2) AS INT)"))
    created = instant(as_of) - F.expr("make_dt_interval(0, _user % 48, 30)")
    return as_registry(
        rows.withColumn("created_at", created).withColumn(
            "first_observed_at", F.col("created_at") + F.expr("make_dt_interval(0, 0, 10 * (_user % 3))")
        )
    )


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan cursors: newest signup instant for rule 4, newest purchase instant for rule 5."""
    return (
        events_k(spark, sf_dir)
        .where("event_type IN ('signup', 'purchase')")
        .groupBy(
            F.expr(MINT).alias("mint"),
            F.expr("CASE event_type WHEN 'signup' THEN 'rule4' ELSE 'rule5' END").alias("rule_key"),
        )
        .agg(F.max("ts").alias("scanned_through"))
    )


def iso_text(column) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a source version polled one to three times, five seconds apart."""
    repeated = dealt(events_k(spark, sf_dir)).withColumn("r", F.explode(F.expr("sequence(0, CAST(event_id % 3 AS INT))")))
    payload = """parse_json('{' || concat_ws(',', '"id":"' || mint || '"', '"updatedAt":"' || updated_at || '"',
        '"name":"polled ' || CAST(user_id AS STRING) || '"', '"symbol":"S' || CAST(event_id % 7 AS STRING) || '"',
        '"decimals":' || CAST(event_id % 9 AS STRING), '"tokenProgram":"prog"',
        '"createdAt":"' || updated_at || '"', CASE WHEN event_id % 2 = 0 THEN '"firstPool":{"id":"F' || CAST(event_id AS STRING)
        || '","createdAt":"' || updated_at || '"}' ELSE '"firstPool":null' END,
        CASE WHEN event_id % 3 = 0 THEN '"audit":{"mintAuthorityDisabled":true}' END,
        '"mcap":' || CAST(value AS STRING), '"r":' || CAST(r AS STRING)) || '}')"""
    return (
        repeated.withColumn("mint", F.expr(MINT))
        .withColumn("updated_at", iso_text("ts"))
        .select(
            F.col("mint").alias("id"),
            "updated_at",
            F.expr(payload).alias("payload"),
            (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, 5 * r)")).alias("observed_at"),
            (F.col("event_id") * 3 + F.col("r")).alias("arrival_seq"),
        )
    )


def known_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry before the ingest batch: keys with a signup before ``KNOWN_UNTIL``, some without a name."""
    seen = (
        events_k(spark, sf_dir)
        .where((F.col("event_type") == "signup") & (F.col("ts") <= instant(KNOWN_UNTIL)))
        .groupBy(F.expr(MINT).alias("mint"), "user_id")
        .agg(F.min("ts").alias("first_observed_at"), F.max("ts").alias("last_changed_at"))
    )
    user = F.col("user_id")
    return as_registry(
        seen.withColumns(
            {
                "tracking_enabled": user % 20 != 0,
                "name": F.when(user % 4 != 0, F.concat(F.lit("old "), user.cast("string"))),
                "source_updated_at": iso_text("last_changed_at"),
                "last_polled_at": F.col("last_changed_at") + F.expr("make_dt_interval(30)"),
            }
        )
    )


def known_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History before the ingest batch: every purchase instant."""
    return events_k(spark, sf_dir).where("event_type = 'purchase'").select(
        F.expr(MINT).alias("mint"), F.col("ts").alias("observed_at")
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream of change events with full tokens; retirements leave out two fields in every other event."""
    rows = events_k(spark, sf_dir).selectExpr(*CHANGE_COLUMNS)
    values = {
        "mint": F.col("mint"),
        "name": F.concat(F.lit("n"), F.col("seq").cast("string")),
        "symbol": F.lit("S"),
        "launchpad": F.col("launchpad"),
        "tracking_enabled": F.lit(True),
        "market_cap": F.col("mcap_after"),
        "liquidity": F.col("liquidity"),
        "volume_5m": F.col("volume_after"),
        "source_updated_at": F.concat(F.lit("v"), F.col("seq").cast("string")),
        "last_changed_at": F.col("ts"),
        "disabled_reason": F.when(F.col("seq") % 5 == 0, F.lit("token reason")),
    }
    types = {
        **{name: "double" for name in ("market_cap", "liquidity", "buy_volume_5m", "sell_volume_5m", "volume_5m", "age_seconds",
                                       "poll_age_seconds", "change_age_seconds")},
        **{name: "int" for name in ("holders", "trades_5m", "traders_5m")},
        **{name: "timestamp" for name in ("last_polled_at", "last_changed_at", "snapshot_observed_at", "disabled_at")},
        "tracking_enabled": "boolean",
    }
    token = F.struct(
        *[values.get(n, F.lit(None)).cast(types.get(n, "string")).alias(n) for n in schemas.TOKEN_FIELDS]
    )
    none = F.lit(None).cast("double")

    def change(value):
        return F.struct(value.alias("absolute"), none.alias("percent"))

    return rows.select(
        "seq",
        "ts",
        "type",
        "mint",
        token.alias("token"),
        F.create_map(
            F.lit("volume_5m"), change(F.col("volume_change")), F.lit("market_cap"), change(F.col("mcap_change"))
        ).alias("changes"),
        F.when(F.col("type") == "token_retired", F.col("reason")).alias("reason"),
        F.when(
            (F.col("type") == "token_retired") & (F.col("seq") % 2 == 0), F.array(F.lit("liquidity"), F.lit("name"))
        ).alias("absent"),
    )


def part_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*PART_COLUMNS)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_k(spark, sf_dir).selectExpr(*TELEMETRY_COLUMNS)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested risk report per order. Lists and accounts are functions of the order row."""
    # The same accounts in every report that has any: their text is written once, not for each row.
    accounts = json.dumps(
        {f"A{j}": {"name": f"N{j % 4}", "type": f"T{j % 2}"} for j in range(50) if j % 10 < 3}, separators=(",", ":")
    )
    body = """'{' || concat_ws(',',
        CASE WHEN n_holders < 24 THEN '"topHolders":' || to_json(holders) END,
        CASE WHEN o_orderkey % 3 <> 0 THEN '"knownAccounts":' || '""" + accounts + """' END,
        CASE WHEN o_orderkey % 7 <> 0 THEN '"markets":' || to_json(markets) END,
        CASE WHEN o_orderkey % 5 <> 0 THEN '"creator":"' || creator || '"' END,
        CASE o_orderkey % 3 WHEN 0 THEN '"lockers":{"a":1,"b":2}' WHEN 1 THEN '"lockers":[1]' END,
        CASE o_orderkey % 4 WHEN 0 THEN '"insiderNetworks":[]' WHEN 1 THEN '"insiderNetworks":{"x":1}' END,
        CASE o_orderkey % 2 WHEN 0 THEN '"creatorTokens":[1,2]' END,
        CASE o_orderkey % 4 WHEN 0 THEN '"mintAuthority":"x"' WHEN 1 THEN '"mintAuthority":""' WHEN 2 THEN '"mintAuthority":null' END,
        CASE o_orderkey % 5 WHEN 0 THEN '"token":{"mintAuthority":null,"freezeAuthority":"y"}' WHEN 1 THEN '"token":{"freezeAuthority":{}}'
             WHEN 2 THEN '"token":5' END,
        CASE o_orderkey % 3 WHEN 0 THEN '"tokenMeta":{"mutable":true,"updateAuthority":[]}' WHEN 1 THEN '"tokenMeta":{"mutable":false,"updateAuthority":["z"]}' END,
        CASE o_orderkey % 4 WHEN 0 THEN '"transferFee":{"authority":"q","basisPoints":5}' WHEN 1 THEN '"transferFee":{}' END,
        CASE WHEN o_orderkey % 6 <> 0 THEN '"risks":' || to_json(risks) END,
        '"score":' || CAST(o_orderkey % 50 AS STRING), '"rugged":' || CASE WHEN o_orderkey % 9 = 0 THEN 'true' ELSE 'false' END,
        '"totalHolders":' || CAST(o_orderkey % 1000 AS STRING), '"totalMarketLiquidity":' || CAST(o_totalprice AS STRING)) || '}'"""
    holders = """transform(filter(sequence(0, n_holders), i -> i > 0), i -> named_struct(
        'address', 'A' || CAST((o_custkey * 7 + i) % 50 AS STRING),
        'owner', 'A' || CAST((o_orderkey + i * 3) % 50 AS STRING),
        'pct', CASE WHEN (o_orderkey + i) % 6 <> 0 THEN CAST((o_orderkey * 13 + i * 29) % 400 AS DOUBLE) / 32 END,
        'insider', CASE WHEN (o_orderkey + i) % 4 = 1 THEN true WHEN (o_orderkey + i) % 4 > 1 THEN false END))"""
    markets = """transform(filter(sequence(0, CAST(o_orderkey % 6 AS INT)), i -> i > 0), i -> named_struct(
        'marketType', CASE i % 3 WHEN 0 THEN 'AMM' WHEN 1 THEN 'CLMM' ELSE '' END,
        'lp', CASE WHEN i <> 4 THEN named_struct(
            'baseUSD', CASE WHEN (o_orderkey + i) % 4 <> 0 THEN CAST((o_orderkey * i) % 1000 AS DOUBLE) / 4 END,
            'quoteUSD', CASE WHEN (o_orderkey + i) % 5 <> 0 THEN CAST((o_orderkey + i) % 800 AS DOUBLE) / 8 END,
            'lpLockedPct', CASE WHEN (o_orderkey + i) % 3 <> 0 THEN CAST(((o_orderkey + i) % 3 - 1) * 50 AS DOUBLE) END) END))"""
    risks = """transform(filter(sequence(0, CAST(o_orderkey % 4 AS INT)), i -> i > 0), i -> named_struct(
        'name', CASE WHEN i <> 3 THEN 'R' || CAST(i AS STRING) END, 'score', CASE WHEN i <> 3 THEN i * 10 END, 'other', i))"""
    return (
        dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
        .selectExpr("*", "CAST(o_orderkey % 25 AS INT) AS n_holders", "'A' || CAST(o_custkey % 50 AS STRING) AS creator")
        .selectExpr("*", f"{holders} AS holders", f"{markets} AS markets", f"{risks} AS risks")
        .selectExpr("o_orderkey AS report_id", f"parse_json({body}) AS report")
    )


def ctes(as_of: str = FULL, inactive_every: int = 20) -> dict[str, str]:
    """DuckDB text of the derived tables, in dependency order."""
    iso = "%Y-%m-%dT%H:%M:%S.%fZ"
    t = f"TIMESTAMP '{as_of}'"
    known = f"TIMESTAMP '{KNOWN_UNTIL}'"
    return {
        "events_k": "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
        "snaps": f"SELECT {', '.join(SNAPSHOT_COLUMNS)} FROM events_k WHERE ts <= {t}",
        "latest": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY observed_at DESC) AS rn FROM snaps) WHERE rn = 1",
        "reg": f"""SELECT mint, user_id, user_id % {inactive_every} <> 0 AS tracking_enabled, min(observed_at) AS first_observed_at,
            min(observed_at) - INTERVAL '1' HOUR * (user_id % 12) AS created_at,
            {t} - INTERVAL '1' SECOND * (user_id % 90) AS last_polled_at, max(observed_at) AS last_changed_at,
            CASE WHEN user_id % 3 <> 0 THEN 'known ' || CAST(user_id AS STRING) END AS name,
            'v' || CAST(epoch_us(max(observed_at)) AS STRING) AS source_updated_at,
            CASE WHEN user_id % {inactive_every} = 0 AND user_id % 40 <> 0 THEN {t} - INTERVAL '1' MINUTE * (user_id % 60) END AS disabled_at,
            CASE WHEN user_id % {inactive_every} = 0 THEN 'earlier' END AS disabled_reason
            FROM snaps GROUP BY mint, user_id""",
        "spread": f"""SELECT mint, user_id, tracking_enabled, last_polled_at, last_changed_at, created_at,
            created_at + INTERVAL '10' MINUTE * (user_id % 3) AS first_observed_at FROM
            (SELECT * REPLACE ({t} - INTERVAL '1' HOUR * (user_id % 48) - INTERVAL '30' MINUTE AS created_at) FROM reg)""",
        "cur": f"""SELECT {MINT} AS mint, CASE event_type WHEN 'signup' THEN 'rule4' ELSE 'rule5' END AS rule_key,
            max(ts) AS scanned_through FROM events_k WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2""",
        "polls": f"""SELECT {MINT} AS id, strftime(ts, '{iso}') AS updated_at, ts AS source_time, user_id, event_id, value, r,
            ts + INTERVAL '1' SECOND * (5 * r) AS observed_at, event_id * 3 + r AS arrival_seq
            FROM (SELECT *, unnest(range(0, event_id % 3 + 1)) AS r FROM events_k)""",
        "known": f"""SELECT {MINT} AS mint, user_id, user_id % 20 <> 0 AS tracking_enabled,
            CASE WHEN user_id % 4 <> 0 THEN 'old ' || CAST(user_id AS STRING) END AS name, max(ts) AS held,
            min(ts) AS first_observed_at, max(ts) AS last_changed_at, max(ts) + INTERVAL '30' DAY AS last_polled_at
            FROM events_k WHERE event_type = 'signup' AND ts <= {known} GROUP BY 1, 2""",
        "versions": """SELECT id AS mint, updated_at, source_time, user_id, event_id, min(observed_at) AS observed_at,
            max(observed_at) AS last_polled_at, min(arrival_seq) AS arrival_seq
            FROM polls GROUP BY 1, 2, 3, 4, 5""",
        "newer": "SELECT v.* FROM versions v LEFT JOIN known k ON k.mint = v.mint WHERE k.held IS NULL OR v.source_time > k.held",
        "chg": f"SELECT {', '.join(CHANGE_COLUMNS)} FROM events_k",
        "tok": f"SELECT {', '.join(PART_COLUMNS)} FROM part",
        "tel": f"SELECT {', '.join(TELEMETRY_COLUMNS)} FROM events_k",
        "holders": """SELECT o_orderkey AS report_id, i, 'A' || CAST(o_custkey % 50 AS STRING) AS creator,
            (o_custkey * 7 + i) % 50 AS a, (o_orderkey + i * 3) % 50 AS o,
            CASE WHEN (o_orderkey + i) % 6 <> 0 THEN CAST((o_orderkey * 13 + i * 29) % 400 AS DOUBLE) / 32 END AS pct,
            CASE WHEN (o_orderkey + i) % 4 = 1 THEN true WHEN (o_orderkey + i) % 4 > 1 THEN false END AS insider
            FROM (SELECT *, unnest(range(1, o_orderkey % 25 + 1)) AS i FROM orders WHERE o_orderkey % 25 < 24)""",
        "markets": """SELECT o_orderkey AS report_id, i, CASE i % 3 WHEN 0 THEN 'AMM' WHEN 1 THEN 'CLMM' ELSE '' END AS market_type,
            CASE WHEN i <> 4 AND (o_orderkey + i) % 4 <> 0 THEN CAST((o_orderkey * i) % 1000 AS DOUBLE) / 4 END AS base_usd,
            CASE WHEN i <> 4 AND (o_orderkey + i) % 5 <> 0 THEN CAST((o_orderkey + i) % 800 AS DOUBLE) / 8 END AS quote_usd,
            CASE WHEN i <> 4 AND (o_orderkey + i) % 3 <> 0 THEN CAST(((o_orderkey + i) % 3 - 1) * 50 AS DOUBLE) END AS locked_pct
            FROM (SELECT *, unnest(range(1, o_orderkey % 6 + 1)) AS i FROM orders WHERE o_orderkey % 7 <> 0)""",
    }


DEPENDS = {
    "events_k": (),
    "snaps": ("events_k",),
    "latest": ("snaps",),
    "reg": ("snaps",),
    "spread": ("reg",),
    "cur": ("events_k",),
    "polls": ("events_k",),
    "known": ("events_k",),
    "versions": ("polls",),
    "newer": ("versions", "known"),
    "chg": ("events_k",),
    "tok": (),
    "tel": ("events_k",),
    "holders": (),
    "markets": (),
}


def with_ctes(needed: tuple[str, ...], body: str, as_of: str = FULL, inactive_every: int = 20, extra: str = "") -> str:
    """``body`` behind the needed CTEs and their dependencies; ``extra`` adds further CTE text."""
    texts = ctes(as_of, inactive_every)
    wanted: list[str] = []

    def visit(name: str) -> None:
        for dependency in DEPENDS[name]:
            visit(dependency)
        if name not in wanted:
            wanted.append(name)

    for name in needed:
        visit(name)
    parts = [f"{name} AS ({texts[name]})" for name in texts if name in wanted]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body
