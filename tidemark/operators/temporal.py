"""24-hour temporal summary for all keys at once.

Long histories of single keys are expected. Everything except drawdown is a fold that combines map-side. Medians run
over samples, of which a key has at most one per five minutes. Drawdown needs order: it is computed inside time slices,
each starting from the peak of the slices before it, so no task ever holds the whole history of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import RETENTION_HOURS, SAMPLE_SECONDS
from tidemark.functions.coerce import instant, ratio, seconds

METRICS = (
    "market_cap",
    "liquidity",
    "holders",
    "organic_score",
    "dev_mints",
    "dev_balance_pct",
    "top_holders_pct",
)
SLICE_SECONDS = 60

# The ratios derived from the activity fields (name, left, right, mode).
ACTIVITY_RATIOS = (
    ("buy_sell_volume_ratio", "buy_volume", "sell_volume", "divide"),
    ("net_flow_ratio", "buy_volume", "sell_volume", "net"),
    ("buy_sell_count_ratio", "num_buys", "num_sells", "divide"),
)


def history(view: DataFrame, as_of, hours: float = RETENTION_HOURS) -> DataFrame:
    """Rows of a ``history_view`` inside the period; the lower bound is inclusive, there is no upper bound."""
    return view.where(F.col("observed_at") >= instant(as_of) - seconds(hours * 3600))


def sample_5m(rows: DataFrame) -> DataFrame:
    """Last row per key and epoch-aligned sample interval, with the fields the sampled statistics use."""
    bucket = F.floor(F.unix_micros("observed_at") / F.lit(SAMPLE_SECONDS * 1_000_000)).alias("bucket")
    newest = rows.groupBy("mint", bucket).agg(
        F.max_by(
            F.struct("observed_at", "market_cap", "liquidity", "organic_score", "stats_1h"), "observed_at"
        ).alias("_row")
    )
    return newest.select("mint", "bucket", "_row.*")


def _known_at(metric: str) -> Column:
    return F.when(F.col(metric).isNotNull(), F.col("observed_at"))


def first_last(metrics: Sequence[str]) -> list[Column]:
    folds = []
    for metric in metrics:
        folds += [
            F.min_by(metric, _known_at(metric)).alias(f"{metric}_start"),
            F.max_by(metric, _known_at(metric)).alias(f"{metric}_current"),
        ]
    return folds


def extremes(metrics: Sequence[str]) -> list[Column]:
    return [
        fold for metric in metrics for fold in (F.min(metric).alias(f"{metric}_min"), F.max(metric).alias(f"{metric}_max"))
    ]


def change_pct(start: Column, current: Column) -> Column:
    return (ratio(current, start) - 1) * F.lit(100.0)


def metric_summary(rows: DataFrame, metric: str) -> DataFrame:
    """First and last known value, extremes and change per key with at least one known value."""
    folded = rows.where(F.col(metric).isNotNull()).groupBy("mint").agg(*first_last([metric]), *extremes([metric]))
    return folded.select(
        "mint",
        F.col(f"{metric}_start").alias("start"),
        F.col(f"{metric}_current").alias("current"),
        F.col(f"{metric}_min").alias("min"),
        F.col(f"{metric}_max").alias("max"),
        change_pct(F.col(f"{metric}_start"), F.col(f"{metric}_current")).alias("change_pct"),
    )


def drawdown(rows: DataFrame, metric: str, slice_s: int = SLICE_SECONDS) -> DataFrame:
    """Per key: earliest instant of the maximum, and the deepest fall below the running peak in percent (at most 0)."""
    known = rows.where(F.col(metric).isNotNull()).select(
        "mint",
        "observed_at",
        F.floor(F.unix_micros("observed_at") / F.lit(slice_s * 1_000_000)).alias("_slice"),
        F.col(metric).alias("_v"),
    )
    key = Window.partitionBy("mint")
    earlier = key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per slice and key reaches these windows.
    slices = (
        known.groupBy("mint", "_slice")
        .agg(F.max("_v").alias("_top"))
        .select(
            "mint",
            "_slice",
            F.max("_top").over(earlier).alias("_before"),
            F.max("_top").over(key).alias("_highest"),
        )
    )
    inside = Window.partitionBy("mint", "_slice").orderBy("observed_at").rowsBetween(Window.unboundedPreceding, 0)
    peaks = known.join(slices, ["mint", "_slice"]).withColumn("_peak", F.greatest("_before", F.max("_v").over(inside)))
    fall = F.when(F.col("_peak") > 0, (F.col("_v") / F.col("_peak") - 1) * F.lit(100.0))
    return peaks.groupBy("mint").agg(
        F.min(F.when(F.col("_v") == F.col("_highest"), F.col("observed_at"))).alias("peak_at"),
        F.least(F.coalesce(F.min(fall), F.lit(0.0)), F.lit(0.0)).alias("max_drawdown_pct"),
    )


def pair_ratio(left: Column, right: Column, mode: str) -> Column:
    """``divide`` or ``net`` ratio; NULL when a side is missing or the denominator is zero."""
    if mode == "divide":
        return ratio(left, right)
    if mode == "net":
        return ratio(left - right, left + right)
    raise ValueError(f"unknown ratio mode {mode!r}")


def summarise_samples(samples: DataFrame, values: Mapping[str, Column], extremes_for: Sequence[str]) -> DataFrame:
    """Current and median per key of each named expression, with min and max where asked. One aggregate for all."""
    named = samples.select("mint", "observed_at", *[value.alias(name) for name, value in values.items()])
    folds = []
    for name in values:
        folds += [
            F.max_by(name, _known_at(name)).alias(f"{name}_current"),
            F.percentile(name, F.lit(0.5)).alias(f"{name}_median"),
        ]
        if name in extremes_for:
            folds += [F.min(name).alias(f"{name}_min"), F.max(name).alias(f"{name}_max")]
    return named.groupBy("mint").agg(*folds)


def ratio_summary(samples: DataFrame, left: Column, right: Column, mode: str = "divide") -> DataFrame:
    """Current, median, min and max of one ratio per key with at least one defined value."""
    summary = summarise_samples(samples, {"r": pair_ratio(left, right, mode)}, ["r"])
    return summary.where("r_current IS NOT NULL").select(
        "mint", *[F.col(f"r_{part}").alias(part) for part in ("current", "median", "min", "max")]
    )


def ownership(rows: DataFrame) -> DataFrame:
    """Start, current and change in percentage points of the two shares, and the current developer key count."""
    shares = ("top_holders_pct", "dev_balance_pct")
    folded = rows.groupBy("mint").agg(*first_last([*shares, "dev_mints"]))
    return folded.select(
        "mint",
        *[
            column
            for share in shares
            for column in (
                F.col(f"{share}_start"),
                F.col(f"{share}_current"),
                (F.col(f"{share}_current") - F.col(f"{share}_start")).alias(f"{share}_change_pp"),
            )
        ],
        "dev_mints_current",
    )


def activity(samples: DataFrame) -> DataFrame:
    """Current and median per key and activity field. Rolling totals are never summed."""
    return (
        samples.select("mint", "observed_at", F.explode("stats_1h").alias("field", "value"))
        .groupBy("mint", "field")
        .agg(F.max_by("value", "observed_at").alias("current"), F.percentile("value", F.lit(0.5)).alias("median"))
    )


def _stat(name: str) -> Column:
    return F.try_element_at("stats_1h", F.lit(name))


def activity_ratio_columns() -> dict[str, Column]:
    return {name: pair_ratio(_stat(left), _stat(right), mode) for name, left, right, mode in ACTIVITY_RATIOS}


def activity_ratios(samples: DataFrame) -> DataFrame:
    """The three derived activity ratios per key."""
    columns = activity_ratio_columns()
    return summarise_samples(samples, columns, list(columns))


def organic_share() -> Column:
    """Organic part of the volume; needs all four inputs."""
    total = _stat("buy_volume") + _stat("sell_volume")
    return ratio(_stat("buy_organic_volume") + _stat("sell_organic_volume"), total)


def organic(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Score from the history (start, current) and the samples (median), and the organic volume share."""
    score = rows.groupBy("mint").agg(*first_last(["organic_score"]))
    sampled = summarise_samples(samples, {"score": F.col("organic_score"), "volume_share": organic_share()}, ["volume_share"])
    return score.join(sampled.drop("score_current"), "mint", "left")


def coverage(rows: DataFrame) -> DataFrame:
    """Number of observations and the span they cover; rows without any metric count."""
    return rows.groupBy("mint").agg(*coverage_folds()).withColumn("hours", span_hours())


def coverage_folds() -> list[Column]:
    return [
        F.count("*").alias("observations"),
        F.min("observed_at").alias("from"),
        F.max("observed_at").alias("to"),
    ]


def span_hours() -> Column:
    return F.round((F.unix_micros("to") - F.unix_micros("from")) / F.lit(3_600_000_000.0), 4)


def temporal_facts(rows: DataFrame) -> DataFrame:
    """Flat per-key facts: one aggregate over the history, one over the samples, and the drawdown pass."""
    samples = sample_5m(rows)
    full = ("market_cap", "liquidity", "holders")
    shares = ("top_holders_pct", "dev_balance_pct")
    folded = rows.groupBy("mint").agg(
        *coverage_folds(), *first_last([*full, *shares, "dev_mints", "organic_score"]), *extremes(full)
    )
    ratios = {
        "liquidity_to_market_cap": pair_ratio(F.col("liquidity"), F.col("market_cap"), "divide"),
        **activity_ratio_columns(),
        "volume_share": organic_share(),
    }
    sampled = summarise_samples(samples, {**ratios, "sampled_score": F.col("organic_score")}, list(ratios))
    facts = (
        folded.join(sampled.drop("sampled_score_current"), "mint", "left")
        .join(drawdown(rows, "market_cap"), "mint", "left")
        .withColumn("hours", span_hours())
    )
    derived = {f"{m}_change_pct": change_pct(F.col(f"{m}_start"), F.col(f"{m}_current")) for m in full}
    for share in shares:
        derived[f"{share}_change_pp"] = F.col(f"{share}_current") - F.col(f"{share}_start")
    return facts.withColumns(derived)


def _section(lead: Column, fields: Mapping[str, Column]) -> Column:
    return F.when(lead.isNotNull(), F.struct(*[value.alias(name) for name, value in fields.items()]))


def _r6(name: str) -> Column:
    return F.round(F.col(name), 6)


def _range(name: str) -> Column:
    return _section(
        F.col(f"{name}_current"), {part: _r6(f"{name}_{part}") for part in ("current", "median", "min", "max")}
    )


def temporal_summary(rows: DataFrame) -> DataFrame:
    """One nested row per key of a ``history``. A section is NULL when its leading metric is unknown."""
    c = F.col
    metric_parts = ("start", "current", "min", "max", "change_pct")

    def metric(name: str) -> dict[str, Column]:
        return {part: _r6(f"{name}_{part}") for part in metric_parts}

    def share(name: str) -> Column:
        return _section(c(f"{name}_start"), {part: _r6(f"{name}_{part}") for part in ("start", "current", "change_pp")})

    ratios = [_range(name).alias(name) for name, *_ in ACTIVITY_RATIOS]
    any_ratio = F.coalesce(*[c(f"{name}_current") for name, *_ in ACTIVITY_RATIOS])
    fields = (
        activity(sample_5m(rows))
        .groupBy("mint")
        # One entry per statistic of the provider, not per observation.
        .agg(
            F.map_from_entries(
                F.array_sort(
                    F.collect_list(
                        F.struct("field", F.struct(_r6("current").alias("current"), _r6("median").alias("median")))
                    )
                )
            ).alias("activity_fields")
        )
    )
    facts = temporal_facts(rows).join(fields, "mint", "left")
    share_names = ("top_holders_pct", "dev_balance_pct")
    any_share = F.coalesce(*[c(f"{name}_start") for name in (*share_names,)], c("dev_mints_current"))
    any_organic = F.coalesce("organic_score_start", "volume_share_current")
    return facts.select(
        "mint",
        F.struct("hours", "observations", "from", "to").alias("history"),
        _section(
            c("market_cap_start"),
            {**metric("market_cap"), "peak_at": c("peak_at"), "max_drawdown_pct": _r6("max_drawdown_pct")},
        ).alias("market_cap"),
        _section(
            c("liquidity_start"),
            {**metric("liquidity"), "liquidity_to_market_cap": _range("liquidity_to_market_cap")},
        ).alias("liquidity"),
        _section(c("holders_start"), metric("holders")).alias("holders"),
        _section(
            any_share, {**{name: share(name) for name in share_names}, "dev_mints_current": _r6("dev_mints_current")}
        ).alias("ownership"),
        _section(
            F.coalesce(any_ratio, F.when(c("activity_fields").isNotNull(), F.lit(0.0))),
            {"fields": c("activity_fields"), "derived": _section(any_ratio, dict(zip([n for n, *_ in ACTIVITY_RATIOS], ratios)))},
        ).alias("activity_1h"),
        _section(
            any_organic,
            {
                "score": _section(
                    c("organic_score_start"),
                    {
                        "start": _r6("organic_score_start"),
                        "current": _r6("organic_score_current"),
                        "median": _r6("sampled_score_median"),
                    },
                ),
                "volume_share": _range("volume_share"),
            },
        ).alias("organic"),
    )


def summary_bundle(summary: DataFrame, tokens: DataFrame) -> DataFrame:
    """Summaries with the identity of their key; empty texts become NULL."""
    identity = tokens.select(
        "mint", *[F.when(F.col(name) != "", F.col(name)).alias(name) for name in ("name", "symbol", "launchpad")]
    )
    return summary.join(identity, "mint", "left").select(
        F.struct("mint", "name", "symbol", "launchpad").alias("token"),
        F.struct(*[name for name in summary.columns if name != "mint"]).alias("summary"),
    )
