"""Registered queries: temporal summary, risk reports, telemetry, preparation and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import TELEMETRY_MAX_EVENTS
from tidemark.operators import prep, risk, telemetry as tm, temporal as tp
from tidemark.plans import fixtures as fx
from tidemark.plans.common import tidy

NOW = fx.FULL
HOURS = 31 * 24
SAMPLE_S = tp.SAMPLE_SECONDS


def history(spark, sf, hours=HOURS):
    return tp.history(fx.history_rows(spark, sf, NOW), NOW, hours)


def samples(spark, sf):
    return tp.sample_5m(history(spark, sf))


def q_history_24h(spark, sf):
    return tidy(history(spark, sf, 24).drop("stats_1h"))


def q_sample_5m(spark, sf):
    return tidy(samples(spark, sf).drop("stats_1h"))


def q_metric_summary(spark, sf):
    return tidy(tp.metric_summary(history(spark, sf), "market_cap"))


def q_drawdown(spark, sf):
    return tidy(tp.drawdown(history(spark, sf), "market_cap", slice_s=3600))


def q_ratio_summary(spark, sf):
    return tidy(tp.ratio_summary(samples(spark, sf), F.col("liquidity"), F.col("market_cap"), "divide"))


def q_ownership(spark, sf):
    return tidy(tp.ownership(history(spark, sf)))


def q_activity_fields(spark, sf):
    return tidy(tp.activity(samples(spark, sf)))


def q_activity_ratios(spark, sf):
    return tidy(tp.activity_ratios(samples(spark, sf)))


def q_organic(spark, sf):
    return tidy(tp.organic(history(spark, sf), samples(spark, sf)))


def q_coverage(spark, sf):
    return tidy(tp.coverage(history(spark, sf)).withColumnsRenamed({"from": "first_at", "to": "last_at"}))


def q_temporal_summary_flat(spark, sf):
    s = tp.temporal_summary(history(spark, sf))
    c = F.col
    flat = s.select(
        "mint",
        c("history.hours").alias("hours"),
        c("history.observations").alias("observations"),
        c("market_cap.start").alias("mc_start"),
        c("market_cap.current").alias("mc_current"),
        c("market_cap.change_pct").alias("mc_change_pct"),
        c("market_cap.peak_at").alias("mc_peak_at"),
        c("market_cap.max_drawdown_pct").alias("mc_drawdown"),
        c("liquidity.max").alias("liq_max"),
        c("liquidity.liquidity_to_market_cap.median").alias("liq_ratio_median"),
        c("holders.min").alias("holders_min"),
        c("ownership.top_holders_pct.change_pp").alias("top_change_pp"),
        c("ownership.dev_mints_current").alias("dev_mints"),
        c("activity_1h.fields")["buy_volume"]["median"].alias("buy_median"),
        c("activity_1h.derived.net_flow_ratio.current").alias("net_current"),
        c("organic.score.median").alias("score_median"),
        c("organic.volume_share.max").alias("share_max"),
    )
    return tidy(flat)


def q_temporal_summary(spark, sf):
    summary = tp.temporal_summary(history(spark, sf))
    tokens = fx.registry(spark, sf, NOW).select("mint", "name", "symbol", F.lit("").alias("launchpad"))
    return tp.summary_bundle(summary, tokens).select(F.to_json("token").alias("token"), F.to_json("summary").alias("summary"))


# --- risk reports -----------------------------------------------------------------------------------------------


def reports(spark, sf):
    return fx.reports(spark, sf)


def q_concentration(spark, sf):
    columns = ["report_id", "top_holders_reported", *[f"top{n}_pct" for n in risk.TOP_SIZES]]
    return tidy(risk.holder_metrics(reports(spark, sf)).select(*columns))


def q_insiders(spark, sf):
    rows = risk.holder_metrics(reports(spark, sf))
    return tidy(rows.select("report_id", "insider_flags_reported", "insiders", "insider_pct", "insider_networks", "creator_tokens"))


def q_creator_share(spark, sf):
    rows = risk.holder_metrics(reports(spark, sf))
    return tidy(rows.select("report_id", "creator_pct", "labelled_pct", "largest_unlabelled_pct"))


def q_known_labels(spark, sf):
    return tidy(risk.known_labels(reports(spark, sf)))


def q_market_metrics(spark, sf):
    rows = risk.market_metrics(reports(spark, sf))
    return tidy(
        rows.select(
            "report_id", "market_count", "largest_market_usd", "largest_market_share_pct", "markets_with_lock_data",
            "markets_with_positive_lock", "markets_with_zero_lock", "lockers",
        )
    )


def q_market_types(spark, sf):
    return tidy(risk.market_types(reports(spark, sf)))


def q_control_flags(spark, sf):
    rows = risk.control_flags(reports(spark, sf))
    return tidy(
        rows.select(
            "report_id", "mint_authority_present", "freeze_authority_present",
            F.try_variant_get("metadata_mutable", "$", "boolean").alias("metadata_mutable"),
            "metadata_update_authority_present", F.col("transfer_fee.authority_present").alias("fee_authority_present"),
            F.col("transfer_fee.basis_points").alias("fee_basis_points"),
        )
    )


def q_risk_list(spark, sf):
    rows = risk.risk_list(reports(spark, sf))
    return tidy(
        rows.select(
            "report_id", risk.list_size(F.col("risks")).alias("risks"),
            F.array_join(F.transform("risks", lambda r: F.coalesce(r["name"], F.lit("-"))), ",").alias("names"),
        )
    )


def q_report_projection(spark, sf):
    rows = risk.project_report(reports(spark, sf))
    return rows.select("report_id", "projection.*", F.to_json("summary").alias("summary"))


def q_report_projection_flat(spark, sf):
    """The scalar figures of the whole projection, taken from its own output."""
    given = lambda path, kind: F.try_variant_get(F.col(f"summary.{path}"), "$", kind).alias(path.split(".")[1])
    own, liq = "summary.ownership", "summary.liquidity"
    rows = risk.project_report(reports(spark, sf)).select(
        "report_id", given("provider_risk.score", "string"), given("provider_risk.rugged", "boolean"), given("ownership.total_holders", "string"),
        f"{own}.top_holders_reported", "projection.top_holders_observed", "projection.markets_observed", "projection.known_accounts_observed",
        *[f"{own}.top{n}_pct" for n in risk.TOP_SIZES], f"{own}.labelled_pct", f"{own}.largest_unlabelled_pct", f"{own}.insider_pct", f"{own}.creator_pct",
        f"{liq}.largest_market_usd", f"{liq}.largest_market_share_pct", f"{liq}.markets_with_lock_data", f"{liq}.markets_with_positive_lock",
        given("token_control.metadata_mutable", "boolean"), "summary.token_control.freeze_authority_present",
    )
    return tidy(rows)


def q_report_long_form(spark, sf):
    rows = risk.long_form(risk.project_report(reports(spark, sf)))
    return tidy(rows)


def q_leak_check(spark, sf):
    """Every fourth projection is given an account address on purpose."""
    base = reports(spark, sf)
    planted = F.when(F.col("report_id") % 4 == 0, F.concat(F.lit("see A"), (F.col("report_id") % 50).cast("string")))
    projected = risk.project_report(base).withColumn("summary", F.struct("summary.*", planted.alias("note")))
    return tidy(risk.leak_check(base, projected))


# Well-formed and malformed keys of 31 to 46 characters, some between white space, one for each document.
PLANTED_KEY = "substr(translate(md5(CAST(doc_id AS STRING)) || md5('k' || CAST(doc_id AS STRING)), '0', CASE WHEN doc_id % 7 = 0 THEN '0' ELSE 'z' END), 1, CAST(31 + doc_id % 16 AS INT))"
PLANTED_WORD = f"CASE doc_id % 3 WHEN 0 THEN chr(9) || {PLANTED_KEY} || chr(10) ELSE {PLANTED_KEY} END"


def q_valid_key(spark, sf):
    docs = fx.table(spark, sf, "documents")
    words = docs.select(F.explode(F.split("text", " ")).alias("word")).union(docs.selectExpr(f"{PLANTED_WORD} AS word"))
    return words.groupBy(
        risk.valid_key(F.col("word")).alias("trimmed"), risk.valid_key(F.col("word"), trim=False).alias("exact")
    ).agg(F.count("*").alias("words"))


KNOWN = "({x} % 10 < 3 AND report_id % 3 <> 0)"
H_KNOWN = f"""hk AS (SELECT *, {KNOWN.format(x='a')} AS ka, {KNOWN.format(x='o')} AS ko FROM holders)"""
REPORT_BASE = "SELECT o_orderkey AS report_id, o_orderkey % 25 < 24 AS has_holders, o_orderkey % 7 <> 0 AS has_markets, o_orderkey FROM orders"
TOPS = ", ".join(f"sum(CASE WHEN rn <= {n} THEN pct END) AS top{n}_pct" for n in risk.TOP_SIZES)
HOLDER_AGG = f"""agg AS (SELECT report_id, count(*) AS n, count(insider) AS flags, count(*) FILTER (WHERE insider) AS ins,
    sum(pct) FILTER (WHERE insider) AS ins_pct, count(pct) FILTER (WHERE insider) AS ins_known,
    sum(pct) FILTER (WHERE report_id % 5 <> 0 AND (creator = 'A' || CAST(a AS STRING) OR creator = 'A' || CAST(o AS STRING))) AS creator_pct,
    sum(pct) FILTER (WHERE ka OR ko) AS labelled_pct, max(pct) FILTER (WHERE NOT (ka OR ko)) AS largest_unlabelled_pct FROM hk GROUP BY report_id),
b AS ({REPORT_BASE})"""
LABELS = """labels_long AS (SELECT DISTINCT report_id, i, pct, 'name' AS kind, 'N' || CAST(x % 4 AS STRING) AS label FROM
    (SELECT report_id, i, pct, a AS x FROM hk WHERE ka UNION ALL SELECT report_id, i, pct, o FROM hk WHERE ko)
    UNION ALL SELECT DISTINCT report_id, i, pct, 'type', 'T' || CAST(x % 2 AS STRING) FROM
    (SELECT report_id, i, pct, a AS x FROM hk WHERE ka UNION ALL SELECT report_id, i, pct, o FROM hk WHERE ko))"""
MARKET_FOLD = """magg AS (SELECT report_id, count(*) AS n, max(usd) AS largest, sum(usd) AS total, count(locked_pct) AS locks,
    count(*) FILTER (WHERE locked_pct > 0) AS pos, count(*) FILTER (WHERE locked_pct <= 0) AS zero FROM
    (SELECT *, CASE WHEN base_usd IS NOT NULL OR quote_usd IS NOT NULL THEN coalesce(base_usd, 0) + coalesce(quote_usd, 0) END AS usd FROM markets) GROUP BY report_id)"""
MARKET_AGG = MARKET_FOLD + f",\nb AS ({REPORT_BASE})"
_MEANS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in risk.METRIC_DEFINITIONS.items())
LONG_FORM = f"""SELECT *, CASE metric {_MEANS} END AS definition FROM (
    SELECT report_id, 'score' AS metric, CAST(report_id % 50 AS DOUBLE) AS value FROM b
    UNION ALL SELECT report_id, 'insider_pct', CASE WHEN ins = 0 THEN 0 ELSE round(ins_pct, 6) END FROM agg WHERE flags > 0 AND (ins = 0 OR ins_known = ins)
    UNION ALL SELECT report_id, 'labelled_pct', round(labelled_pct, 6) FROM agg WHERE labelled_pct IS NOT NULL
    UNION ALL SELECT report_id, 'largest_market_share_pct', round(largest / total * 100, 6) FROM magg WHERE total > 0
    UNION ALL SELECT b.report_id, 'markets_with_positive_lock', CAST(coalesce(pos, 0) AS DOUBLE) FROM b LEFT JOIN magg ON magg.report_id = b.report_id WHERE has_markets
    UNION ALL SELECT report_id, 'top10_pct', round(sum(pct), 6) FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pct DESC) AS rn FROM holders WHERE pct IS NOT NULL)
    WHERE rn <= 10 GROUP BY report_id)"""
PROJECTION_FLAT = """SELECT b.report_id, CAST(b.report_id % 50 AS STRING) AS score, b.report_id % 9 = 0 AS rugged, CAST(b.report_id % 1000 AS STRING) AS total_holders,
    CASE WHEN has_holders THEN coalesce(agg.n, 0) END AS top_holders_reported, CASE WHEN has_holders THEN coalesce(agg.n, 0) END AS top_holders_observed,
    CASE WHEN has_markets THEN coalesce(magg.n, 0) END AS markets_observed, CAST(CASE WHEN b.report_id % 3 <> 0 THEN 15 END AS BIGINT) AS known_accounts_observed,
    t.top1_pct, t.top5_pct, t.top10_pct, t.top20_pct, round(labelled_pct, 6) AS labelled_pct, round(largest_unlabelled_pct, 6) AS largest_unlabelled_pct,
    CASE WHEN flags > 0 AND ins = 0 THEN 0 WHEN flags > 0 AND ins_known = ins THEN round(ins_pct, 6) END AS insider_pct, round(creator_pct, 6) AS creator_pct,
    round(largest, 6) AS largest_market_usd, round(CASE WHEN total > 0 THEN largest / total * 100 END, 6) AS largest_market_share_pct,
    CASE WHEN has_markets THEN coalesce(locks, 0) END AS markets_with_lock_data, CASE WHEN has_markets THEN coalesce(pos, 0) END AS markets_with_positive_lock,
    CASE b.report_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS metadata_mutable, CASE b.report_id % 5 WHEN 0 THEN true WHEN 1 THEN false END AS freeze_authority_present
    FROM b LEFT JOIN agg ON agg.report_id = b.report_id LEFT JOIN magg ON magg.report_id = b.report_id
    LEFT JOIN (SELECT report_id, """ + ", ".join(f"round(sum(CASE WHEN rn <= {n} THEN pct END), 6) AS top{n}_pct" for n in risk.TOP_SIZES) + """ FROM
        (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pct DESC) AS rn FROM holders WHERE pct IS NOT NULL) GROUP BY report_id) t ON t.report_id = b.report_id"""

# --- temporal SQL -----------------------------------------------------------------------------------------------

HIST = """hist AS (SELECT mint, observed_at, mcap AS market_cap, liquidity, CAST(holder_count AS DOUBLE) AS holders, organic_score, dev_mints, dev_balance_pct,
    top_holders_pct, buy_volume, sell_volume, buy_organic_volume, sell_organic_volume, num_buys, num_sells FROM snaps)"""
SAMPLES = HIST + f""",
smp AS (SELECT * FROM (SELECT *, epoch_us(observed_at) // {SAMPLE_S * 1_000_000} AS bucket,
    row_number() OVER (PARTITION BY mint, epoch_us(observed_at) // {SAMPLE_S * 1_000_000} ORDER BY observed_at DESC) AS rn FROM hist) WHERE rn = 1)"""


def first_of(metric):
    return f"arg_min({metric}, observed_at) FILTER (WHERE {metric} IS NOT NULL)"


def last_of(metric):
    return f"arg_max({metric}, observed_at) FILTER (WHERE {metric} IS NOT NULL)"


DRAW = """peaks AS (SELECT *, max(market_cap) OVER (PARTITION BY mint ORDER BY observed_at ROWS UNBOUNDED PRECEDING) AS peak,
    max(market_cap) OVER (PARTITION BY mint) AS top FROM hist WHERE market_cap IS NOT NULL),
draw AS (SELECT mint, min(CASE WHEN market_cap = top THEN observed_at END) AS peak_at,
    least(0, coalesce(min(CASE WHEN peak > 0 THEN (market_cap / peak - 1) * 100 END), 0)) AS dd FROM peaks GROUP BY mint)"""
LONG_STATS = "stats AS (" + " UNION ALL ".join(
    f"SELECT mint, observed_at, '{n}' AS field, CAST({n} AS DOUBLE) AS value FROM smp WHERE {n} IS NOT NULL" for n in fx.STATS
) + ")"
RATIO = {
    "liquidity_to_market_cap": "CASE WHEN market_cap <> 0 THEN liquidity / market_cap END",
    "buy_sell_volume_ratio": "CASE WHEN sell_volume <> 0 THEN buy_volume / sell_volume END",
    "net_flow_ratio": "CASE WHEN buy_volume + sell_volume <> 0 THEN (buy_volume - sell_volume) / (buy_volume + sell_volume) END",
    "buy_sell_count_ratio": "CASE WHEN num_sells <> 0 THEN CAST(num_buys AS DOUBLE) / num_sells END",
    "volume_share": "CASE WHEN buy_volume + sell_volume <> 0 THEN (buy_organic_volume + sell_organic_volume) / (buy_volume + sell_volume) END",
}
RATIOS = "rat AS (SELECT mint, observed_at, organic_score, " + ", ".join(f"{e} AS {n}" for n, e in RATIO.items()) + " FROM smp)"


def four(name, prefix=""):
    return f"""round({last_of(name)}, 6) AS {prefix}current, round(median({name}), 6) AS {prefix}median,
        round(min({name}), 6) AS {prefix}min, round(max({name}), 6) AS {prefix}max"""


def hist_sql(body, extra=HIST):
    return fx.with_ctes(("snaps",), body, extra=extra)


def tel_sql(body, extra=""):
    return fx.with_ctes(("tel",), body, extra=extra)


# --- telemetry ---------------------------------------------------------------------------------------------------


def raw_events(spark, sf):
    return fx.dealt(fx.telemetry(spark, sf)).selectExpr("seq", "received_at", f"{fx.TELEMETRY_BODY} AS body")


def telemetry(spark, sf):
    return fx.telemetry(spark, sf).withColumnRenamed("at_text", "at")


def q_validate_events(spark, sf):
    return tidy(tm.validate_events(raw_events(spark, sf)).select("seq", "type", "at", "valid"))


def q_validation_counts(spark, sf):
    return tm.validation_counts(tm.validate_events(raw_events(spark, sf)))


def q_forbidden_keys(spark, sf):
    return raw_events(spark, sf).select("seq", tm.has_forbidden_key(F.col("body")).alias("forbidden"))


def q_retain_events(spark, sf):
    return tidy(tm.retain_events(raw_events(spark, sf), NOW, retention_s=15 * 86400).select("seq", "received_at"))


def q_retention_counts(spark, sf):
    return tm.retention_counts(raw_events(spark, sf), NOW, 15 * 86400, TELEMETRY_MAX_EVENTS, 120)


def q_latest_events(spark, sf):
    rows = tm.latest_events(telemetry(spark, sf))
    return tidy(rows.select("type", "origin", "seq", "rpm60", "latency_ms"))


def q_stage_metrics(spark, sf):
    return tidy(tm.stage_metrics(tm.latest_events(telemetry(spark, sf))))


def q_rpm60(spark, sf):
    rows = fx.telemetry(spark, sf).where("lane IS NOT NULL").select("seq", "lane", F.col("received_at").alias("at"))
    return tidy(tm.rpm60(rows, window_s=6 * 3600, slice_s=86400).select("seq", "lane", "rpm60"))


def q_dedupe_events(spark, sf):
    return tidy(tm.dedupe_events(telemetry(spark, sf)).select("type", "at", "seq"))


# --- preparation -------------------------------------------------------------------------------------------------


def refs(spark, sf):
    """Links of every page and its own address as references; schemes and titles vary by page."""
    return fx.table(spark, sf, "pages").selectExpr(
        "page_id div 10 AS answer_id",
        "page_id AS pos",
        "CASE WHEN page_id % 5 = 0 THEN 'javascript:' || url WHEN page_id % 5 = 1 THEN regexp_extract(url, '^[^/]*//[^/]*', 0) "
        "WHEN page_id % 5 = 2 THEN upper(regexp_extract(url, '^[a-z]*://', 0)) || 'x.example' WHEN page_id % 5 = 3 THEN 'http:///nohost' ELSE url END AS url",
        "CASE WHEN page_id % 3 = 0 THEN '' ELSE nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') END AS title",
    )


REFS = r"""refs AS (SELECT page_id // 10 AS answer_id, page_id AS pos,
    CASE WHEN page_id % 5 = 0 THEN 'javascript:' || url WHEN page_id % 5 = 1 THEN regexp_extract(url, '^[^/]*//[^/]*')
    WHEN page_id % 5 = 2 THEN upper(regexp_extract(url, '^[a-z]*://')) || 'x.example' WHEN page_id % 5 = 3 THEN 'http:///nohost' ELSE url END AS url,
    CASE WHEN page_id % 3 = 0 THEN '' ELSE nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') END AS title FROM pages)"""


def q_safe_sources(spark, sf):
    return prep.safe_sources(refs(spark, sf))


def q_context_size(spark, sf):
    return tidy(prep.context_size(fx.table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text"))


def scored(spark, sf):
    documents = fx.table(spark, sf, "documents")
    actual = documents.selectExpr(
        "doc_id AS case_id", "n_chars > 300 AS queried", "CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS quality",
        "CASE WHEN lang = 'en' THEN NULL ELSE 0 END AS toxic",
    )
    expected = fx.table(spark, sf, "labels").selectExpr(
        "doc_id AS case_id", "doc_id % 4 <> 0 AS queried", "quality", "CASE WHEN toxic = 1 THEN NULL ELSE toxic END AS toxic"
    )
    return prep.score_cases(actual, expected, ["quality", "toxic"])


def q_score_cases(spark, sf):
    return scored(spark, sf)


def q_pass_rate(spark, sf):
    return tidy(prep.pass_rate(scored(spark, sf)))


SCORES = """scored AS (SELECT e.doc_id AS case_id, d.doc_id IS NOT NULL AND (d.n_chars > 300) IS NOT DISTINCT FROM (e.doc_id % 4 <> 0)
    AND (e.doc_id % 4 = 0 OR ((CASE WHEN d.n_chars > 1000 THEN 1 ELSE 0 END) IS NOT DISTINCT FROM e.quality
    AND (CASE WHEN d.lang = 'en' THEN NULL ELSE 0 END) IS NOT DISTINCT FROM (CASE WHEN e.toxic = 1 THEN NULL ELSE e.toxic END))) AS passed
    FROM labels e LEFT JOIN documents d ON d.doc_id = e.doc_id)"""
VALID = "type <> 'unknown' AND seq % 19 <> 0 AND seq % 11 <> 0 AND seq % 13 <> 0"
LATEST_TEL = """latest_tel AS (SELECT * FROM (SELECT *, CASE type WHEN 'discovery_tick' THEN source WHEN 'search_lane_tick' THEN lane END AS origin,
    row_number() OVER (PARTITION BY type, CASE type WHEN 'discovery_tick' THEN source WHEN 'search_lane_tick' THEN lane END ORDER BY seq DESC) AS rn
    FROM tel WHERE type <> 'unknown') WHERE rn = 1)"""


def _stage(column, kind):
    return f"coalesce(sum(coalesce({column}, 0)) FILTER (WHERE type = '{kind}'), 0) AS {column}"


QUERIES = {
    "history_24h": (q_history_24h, hist_sql(f"""SELECT mint, epoch_us(observed_at) AS observed_at_us, round(market_cap, 6) AS market_cap, round(liquidity, 6) AS liquidity, holders,
        round(organic_score, 6) AS organic_score, dev_mints, round(dev_balance_pct, 6) AS dev_balance_pct, round(top_holders_pct, 6) AS top_holders_pct
        FROM hist WHERE observed_at >= TIMESTAMP '{NOW}' - INTERVAL '24' HOUR""")),
    "sample_5m": (q_sample_5m, hist_sql("""SELECT mint, bucket, epoch_us(observed_at) AS observed_at_us, round(market_cap, 6) AS market_cap, round(liquidity, 6) AS liquidity,
        round(organic_score, 6) AS organic_score FROM smp""", SAMPLES)),
    "metric_summary": (q_metric_summary, hist_sql(f"""SELECT mint, round(s, 6) AS start, round(c, 6) AS current, round(lo, 6) AS min, round(hi, 6) AS max,
        round(CASE WHEN s <> 0 THEN (c / s - 1) * 100 END, 6) AS change_pct FROM (SELECT mint, {first_of('market_cap')} AS s, {last_of('market_cap')} AS c,
        min(market_cap) AS lo, max(market_cap) AS hi FROM hist GROUP BY mint) WHERE s IS NOT NULL""")),
    "drawdown": (q_drawdown, hist_sql("SELECT mint, epoch_us(peak_at) AS peak_at_us, round(dd, 6) AS max_drawdown_pct FROM draw", HIST + ",\n" + DRAW)),
    "ratio_summary": (q_ratio_summary, hist_sql(f"SELECT mint, {four('liquidity_to_market_cap')} FROM rat WHERE liquidity_to_market_cap IS NOT NULL GROUP BY mint", SAMPLES + ",\n" + RATIOS)),
    "ownership": (q_ownership, hist_sql(f"""SELECT mint, round(a, 6) AS top_holders_pct_start, round(b, 6) AS top_holders_pct_current, round(b - a, 6) AS top_holders_pct_change_pp,
        round(c, 6) AS dev_balance_pct_start, round(d, 6) AS dev_balance_pct_current, round(d - c, 6) AS dev_balance_pct_change_pp, dm AS dev_mints_current FROM (
        SELECT mint, {first_of('top_holders_pct')} AS a, {last_of('top_holders_pct')} AS b, {first_of('dev_balance_pct')} AS c, {last_of('dev_balance_pct')} AS d,
        {last_of('dev_mints')} AS dm FROM hist GROUP BY mint)""")),
    "activity_fields": (q_activity_fields, hist_sql("SELECT mint, field, round(arg_max(value, observed_at), 6) AS current, round(median(value), 6) AS median FROM stats GROUP BY mint, field", SAMPLES + ",\n" + LONG_STATS)),
    "activity_ratios": (q_activity_ratios, hist_sql("SELECT mint, " + ", ".join(four(n, n + "_") for n in list(RATIO)[1:4]) + " FROM rat GROUP BY mint", SAMPLES + ",\n" + RATIOS)),
    "organic": (q_organic, hist_sql(f"""SELECT h.mint, organic_score_start, organic_score_current, score_median, volume_share_current, volume_share_median, volume_share_min, volume_share_max
        FROM (SELECT mint, round({first_of('organic_score')}, 6) AS organic_score_start, round({last_of('organic_score')}, 6) AS organic_score_current FROM hist GROUP BY mint) h
        LEFT JOIN (SELECT mint, round(median(organic_score), 6) AS score_median, {four('volume_share', 'volume_share_')} FROM rat GROUP BY mint) s ON s.mint = h.mint""", SAMPLES + ",\n" + RATIOS)),
    "coverage": (q_coverage, hist_sql("""SELECT mint, count(*) AS observations, epoch_us(min(observed_at)) AS first_at_us, epoch_us(max(observed_at)) AS last_at_us,
        round((epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / CAST(3600000000 AS DOUBLE), 4) AS hours FROM hist GROUP BY mint""")),
    "temporal_summary_flat": (q_temporal_summary_flat, hist_sql(f"""SELECT h.mint, hours, observations, round(a, 6) AS mc_start, round(b, 6) AS mc_current,
        round(CASE WHEN a <> 0 THEN (b / a - 1) * 100 END, 6) AS mc_change_pct, epoch_us(d.peak_at) AS mc_peak_at_us, round(d.dd, 6) AS mc_drawdown, round(lmax, 6) AS liq_max,
        round(r.lr, 6) AS liq_ratio_median, round(hmin, 6) AS holders_min, round(t2 - t1, 6) AS top_change_pp, round(dm, 6) AS dev_mints,
        round(st.m, 6) AS buy_median, round(r.nf, 6) AS net_current, round(r.sm, 6) AS score_median, round(r.vs, 6) AS share_max
        FROM (SELECT mint, count(*) AS observations, round((epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / CAST(3600000000 AS DOUBLE), 4) AS hours,
            {first_of('market_cap')} AS a, {last_of('market_cap')} AS b, max(liquidity) AS lmax, min(holders) AS hmin, {first_of('top_holders_pct')} AS t1,
            {last_of('top_holders_pct')} AS t2, {last_of('dev_mints')} AS dm FROM hist GROUP BY mint) h
        LEFT JOIN draw d ON d.mint = h.mint LEFT JOIN (SELECT mint, median(value) AS m FROM stats WHERE field = 'buy_volume' GROUP BY mint) st ON st.mint = h.mint
        LEFT JOIN (SELECT mint, median(liquidity_to_market_cap) AS lr, {last_of('net_flow_ratio')} AS nf, median(organic_score) AS sm, max(volume_share) AS vs FROM rat GROUP BY mint) r
        ON r.mint = h.mint""", SAMPLES + ",\n" + RATIOS + ",\n" + DRAW + ",\n" + LONG_STATS)),
    "temporal_summary": (q_temporal_summary, None),
    "concentration": (q_concentration, fx.with_ctes(("holders",), f"""SELECT b.report_id, CASE WHEN has_holders THEN coalesce(n, 0) END AS top_holders_reported, {', '.join(f'top{n}_pct' for n in risk.TOP_SIZES)}
        FROM b LEFT JOIN agg ON agg.report_id = b.report_id LEFT JOIN (SELECT report_id, {TOPS} FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY pct DESC) AS rn
        FROM holders WHERE pct IS NOT NULL) GROUP BY report_id) t ON t.report_id = b.report_id""", extra=H_KNOWN + ",\n" + HOLDER_AGG)),
    "insiders": (q_insiders, fx.with_ctes(("holders",), """SELECT b.report_id, CASE WHEN has_holders THEN coalesce(flags, 0) END AS insider_flags_reported, CASE WHEN flags > 0 THEN ins END AS insiders,
        CASE WHEN flags > 0 AND ins = 0 THEN 0 WHEN flags > 0 AND ins_known = ins THEN ins_pct END AS insider_pct,
        CAST(CASE b.report_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS BIGINT) AS insider_networks, CAST(CASE WHEN b.report_id % 2 = 0 THEN 2 END AS BIGINT) AS creator_tokens
        FROM b LEFT JOIN agg ON agg.report_id = b.report_id""", extra=H_KNOWN + ",\n" + HOLDER_AGG)),
    "creator_share": (q_creator_share, fx.with_ctes(("holders",), "SELECT b.report_id, creator_pct, labelled_pct, largest_unlabelled_pct FROM b LEFT JOIN agg ON agg.report_id = b.report_id", extra=H_KNOWN + ",\n" + HOLDER_AGG)),
    "known_labels": (q_known_labels, fx.with_ctes(("holders",), "SELECT report_id, kind, label, count(*) AS holders, sum(pct) AS pct FROM labels_long GROUP BY 1, 2, 3", extra=H_KNOWN + ",\n" + LABELS)),
    "market_metrics": (q_market_metrics, fx.with_ctes(("markets",), """SELECT b.report_id, CASE WHEN has_markets THEN coalesce(n, 0) END AS market_count, round(largest, 6) AS largest_market_usd,
        round(CASE WHEN total > 0 THEN largest / total * 100 END, 6) AS largest_market_share_pct, CASE WHEN has_markets THEN coalesce(locks, 0) END AS markets_with_lock_data,
        CASE WHEN has_markets THEN coalesce(pos, 0) END AS markets_with_positive_lock, CASE WHEN has_markets THEN coalesce(zero, 0) END AS markets_with_zero_lock,
        CAST(CASE b.report_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS BIGINT) AS lockers FROM b LEFT JOIN magg ON magg.report_id = b.report_id""", extra=MARKET_AGG)),
    "market_types": (q_market_types, fx.with_ctes(("markets",), "SELECT report_id, market_type, count(*) AS markets FROM markets WHERE market_type <> '' GROUP BY 1, 2")),
    "control_flags": (q_control_flags, """SELECT o_orderkey AS report_id,
        CASE WHEN o_orderkey % 5 = 0 THEN false ELSE CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END END AS mint_authority_present,
        CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS freeze_authority_present,
        CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS metadata_mutable,
        CASE o_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS metadata_update_authority_present,
        CASE o_orderkey % 4 WHEN 0 THEN true END AS fee_authority_present, CASE o_orderkey % 4 WHEN 0 THEN '5' END AS fee_basis_points FROM orders"""),
    "risk_list": (q_risk_list, """SELECT o_orderkey AS report_id, CAST(CASE WHEN o_orderkey % 6 <> 0 THEN least(o_orderkey % 4, 2) END AS BIGINT) AS risks,
        CASE WHEN o_orderkey % 6 <> 0 THEN CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'R1' ELSE 'R1,R2' END END AS names FROM orders"""),
    "report_projection": (q_report_projection, None),
    "report_long_form": (q_report_long_form, fx.with_ctes(("holders", "markets"), LONG_FORM, extra=H_KNOWN + ",\n" + HOLDER_AGG + ",\n" + MARKET_FOLD)),
    "report_projection_flat": (q_report_projection_flat, fx.with_ctes(("holders", "markets"), PROJECTION_FLAT, extra=H_KNOWN + ",\n" + HOLDER_AGG + ",\n" + MARKET_FOLD)),
    "leak_check": (q_leak_check, fx.with_ctes(("holders",), """SELECT b.report_id, count(x) AS addresses,
        b.report_id % 4 = 0 AND count(x) FILTER (WHERE starts_with('A' || CAST(b.report_id % 50 AS STRING), 'A' || CAST(x AS STRING))) > 0 AS leaks
        FROM b LEFT JOIN (SELECT report_id, a AS x FROM holders UNION SELECT report_id, o FROM holders
            UNION SELECT o_orderkey, j FROM orders, (SELECT unnest(range(0, 50)) AS j) WHERE j % 10 < 3 AND o_orderkey % 3 <> 0
            UNION SELECT o_orderkey, o_custkey % 50 FROM orders WHERE o_orderkey % 5 <> 0) addr ON addr.report_id = b.report_id GROUP BY b.report_id""", extra=f"b AS ({REPORT_BASE})")),
    "valid_key": (q_valid_key, rf"""SELECT regexp_full_match(regexp_replace(word, '^\s+|\s+$', '', 'g'), '[1-9A-HJ-NP-Za-km-z]{{32,44}}') AS trimmed, regexp_full_match(word, '[1-9A-HJ-NP-Za-km-z]{{32,44}}') AS exact,
        count(*) AS words FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents UNION ALL SELECT {PLANTED_WORD} FROM documents) GROUP BY 1, 2"""),
    "validate_events": (q_validate_events, tel_sql(f"SELECT seq, type, CASE WHEN seq % 19 = 0 THEN '' ELSE at_text END AS at, {VALID} AS valid FROM tel")),
    "validation_counts": (q_validation_counts, tel_sql(f"SELECT count(*) FILTER (WHERE {VALID}) AS received, count(*) FILTER (WHERE NOT ({VALID})) AS invalid FROM tel")),
    "forbidden_keys": (q_forbidden_keys, tel_sql("SELECT seq, seq % 13 = 0 AS forbidden FROM tel")),
    "retain_events": (q_retain_events, tel_sql(f"SELECT seq, epoch_us(received_at) AS received_at_us FROM tel WHERE received_at >= TIMESTAMP '{NOW}' - INTERVAL '15' DAY")),
    "retention_counts": (q_retention_counts, tel_sql(f"""SELECT count(*) AS events, count(*) FILTER (WHERE NOT young) AS expired, count(*) FILTER (WHERE young AND strlen(body) > 120) AS oversized,
        greatest(count(*) FILTER (WHERE young AND strlen(body) <= 120) - {TELEMETRY_MAX_EVENTS}, 0) AS beyond_limit, least(count(*) FILTER (WHERE young AND strlen(body) <= 120), {TELEMETRY_MAX_EVENTS}) AS kept
        FROM (SELECT received_at >= TIMESTAMP '{NOW}' - INTERVAL '15' DAY AS young, {fx.TELEMETRY_BODY} AS body FROM tel)""")),
    "latest_events": (q_latest_events, tel_sql("SELECT type, origin, seq, round(rpm60, 6) AS rpm60, round(latency_ms, 6) AS latency_ms FROM latest_tel", LATEST_TEL)),
    "stage_metrics": (q_stage_metrics, tel_sql(f"""SELECT {_stage('response_items', 'discovery_tick')}, {_stage('new_mints', 'discovery_tick')}, count(*) FILTER (WHERE type = 'search_lane_tick') AS lanes,
        {_stage('rpm60', 'search_lane_tick')}, {_stage('polled_tokens', 'search_flush')}, {_stage('source_versions', 'search_flush')}, {_stage('new_snapshots', 'search_flush')},
        {_stage('affected_count', 'lifecycle_tick')}, round(median(latency_ms) FILTER (WHERE type = 'search_lane_tick'), 6) AS median_latency_ms FROM latest_tel""", LATEST_TEL)),
    "rpm60": (q_rpm60, tel_sql("SELECT seq, lane, count(*) OVER (PARTITION BY lane ORDER BY received_at RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW) AS rpm60 FROM tel WHERE lane IS NOT NULL")),
    "dedupe_events": (q_dedupe_events, tel_sql("SELECT type, at_text AS at, min(seq) AS seq FROM tel GROUP BY type, at_text, CASE type WHEN 'discovery_tick' THEN source WHEN 'search_lane_tick' THEN lane END")),
    "safe_sources": (q_safe_sources, "WITH " + REFS + r""" SELECT answer_id, pos, CASE WHEN title <> '' THEN title ELSE url END AS title, url FROM (
        SELECT *, row_number() OVER (PARTITION BY answer_id, url ORDER BY pos) AS rn FROM refs WHERE regexp_matches(url, '^(?i:https?)://[^/?#]')) WHERE rn = 1"""),
    "context_size": (q_context_size, "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST((length(text) + 3) // 4 AS BIGINT) AS rough_tokens_chars, CAST((strlen(text) + 3) // 4 AS BIGINT) AS rough_tokens_bytes FROM documents"),
    "score_cases": (q_score_cases, "WITH " + SCORES + " SELECT case_id, passed FROM scored"),
    "pass_rate": (q_pass_rate, "WITH " + SCORES + " SELECT count(*) FILTER (WHERE passed) AS passed, count(*) AS cases, round(count(*) FILTER (WHERE passed) / CAST(count(*) AS DOUBLE), 6) AS pass_rate FROM scored"),
}
