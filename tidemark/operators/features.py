"""Per-key and per-group features of a population."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.coerce import finite
from tidemark.functions.quantile import exact_quantiles

# Quantiles, size scale, age scale, packing and move thresholds.
MARKET_QUANTILES = (0.05, 0.995)
LIQUIDITY_QUANTILES = (0.05, 0.98)
HOLDER_QUANTILE = 0.95
SIZE_MIN, SIZE_MAX, SIZE_EXPONENT = 4.0, 54.0, 1.45
AGE_SCALE_S = 6 * 3600.0
AGE_CORE_S = 30 * 86400.0
GAP, EDGE, HUB_SIZE, HUB_MARGIN = 3.0, 2.0, 28.0, 18.0
MIN_FOOTPRINT, FOOTPRINT_PADDING, PACKING_DENSITY = 88.0, 30.0, 0.64
MOVE_VISIBLE, MOVE_STRONG = 0.03, 0.10


def positive(value: Column) -> Column:
    """The number when finite and above zero, else NULL."""
    number = value.cast("double")
    return F.when((number > 0) & (number < F.lit(float("inf"))), number)


def log_size(value: Column) -> Column:
    return F.log10(positive(value) + 1)


def robust_log_range(tokens: DataFrame, field: str, low: float = 0.05, high: float = 0.98) -> DataFrame:
    """One row ``low, high``: quantiles of the log size. Equal quantiles are widened by one; no value gives NULLs."""
    logs = tokens.select(log_size(F.col(field)).alias("log"))
    ends = exact_quantiles(logs, "log", {"low": low, "high": high})
    return ends.select("low", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(F.col("low") + 1).alias("high"))


def clip(value: Column) -> Column:
    """To 0..1; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def normalized_log(tokens: DataFrame, field: str, limits: DataFrame, name: str) -> DataFrame:
    """Adds the log size on the scale of a one-row range, clipped to 0..1."""
    low, high = limits.select("low").scalar(), limits.select("high").scalar()
    return tokens.withColumn(name, clip((log_size(F.col(field)) - low) / (high - low)))


def size_score(normalized: Column) -> Column:
    return F.lit(SIZE_MIN) + F.lit(SIZE_MAX - SIZE_MIN) * F.pow(normalized, F.lit(SIZE_EXPONENT))


def freshness(age_seconds: Column) -> Column:
    """1 for a new key falling to 0 at thirty days; NULL for an unknown or negative age."""
    age = finite(age_seconds)
    faded = F.lit(1.0) - F.log1p(age / AGE_SCALE_S) / F.log1p(F.lit(AGE_CORE_S / AGE_SCALE_S))
    return F.when(age >= AGE_CORE_S, F.lit(0.0)).when(age >= 0, clip(faded))


def holder_scale(tokens: DataFrame, name: str = "holder_score") -> DataFrame:
    """Adds the holders' log size relative to its upper quantile over all keys."""
    logs = tokens.select(log_size(F.col("holders")).alias("log"))
    ceiling = exact_quantiles(logs, "log", {"ceiling": HOLDER_QUANTILE}).scalar()
    return tokens.withColumn(name, F.when(ceiling > 0, clip(log_size(F.col("holders")) / ceiling)))


def group_footprint(sized: DataFrame) -> DataFrame:
    """Members and radius of the area each launchpad's keys need; ``sized`` has ``launchpad, size`` (NULL = minimum)."""
    reach = F.coalesce(F.col("size"), F.lit(SIZE_MIN)) + F.lit(GAP + EDGE)
    hub = pi * (HUB_SIZE + HUB_MARGIN) ** 2
    packed = F.sqrt((F.sum(reach * reach) * F.lit(pi) + F.lit(hub)) / F.lit(pi * PACKING_DENSITY))
    return sized.groupBy("launchpad").agg(
        F.count("*").alias("members"),
        F.greatest(F.lit(MIN_FOOTPRINT), packed + F.lit(FOOTPRINT_PADDING)).alias("radius"),
    )


def move_flags(diff: DataFrame) -> DataFrame:
    """Relative market-cap move of updated keys with ``visible`` and ``strong`` flags and the direction."""
    updated = diff.where(F.col("type") == "token_updated").select(
        "mint",
        F.col("token.market_cap").alias("after"),
        (F.col("token.market_cap") - F.col("changes")["market_cap"]["absolute"]).alias("before"),
    )
    # Conditions on the plain values: they are pushed below the projection, where a long expression would be repeated.
    limit = F.lit(float("inf"))
    known = updated.where((F.col("after") > 0) & (F.col("after") < limit) & (F.col("before") > 0) & (F.col("before") < limit))
    rows = known.select("mint", ((F.col("after") - F.col("before")) / F.col("before")).alias("move"))
    size = F.abs("move")
    return rows.select(
        "mint",
        "move",
        (size >= MOVE_VISIBLE).alias("visible"),
        (size >= MOVE_STRONG).alias("strong"),
        F.signum("move").cast("int").alias("direction"),
    )


def unit_hash(key: Column) -> Column:
    """Stable number in 0..1 per text, the same in every engine: the leading 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)
