"""Bounded ranking and search over the current projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.config import RANK_DEFAULT_LIMIT, RANK_MAX_LIMIT, SEARCH_LIMIT
from tidemark.functions.coerce import finite, strip
from tidemark.session import stored

# Fields a ranking may sort by, and the sort orders.
RANK_FIELDS = (
    "market_cap",
    "liquidity",
    "holders",
    "trades_5m",
    "traders_5m",
    "volume_5m",
    "age_seconds",
    "change_age_seconds",
)
SORT_ORDERS = ("desc", "asc")
RANK_ARGUMENTS = ("sort_by", "sort_order", "limit", "launchpad")
RANK_OUTPUT = ("mint", "name", "symbol", "launchpad", *RANK_FIELDS)


class RankArgumentError(ValueError):
    """An argument the bounded ranking does not accept."""


def launchpad_of() -> Column:
    return F.when(F.col("launchpad") != "", F.col("launchpad")).otherwise("unknown")


def active_tokens(tokens: DataFrame) -> DataFrame:
    """Everything not explicitly inactive: an unknown flag counts as active here."""
    return tokens.where(F.coalesce(F.col("tracking_enabled"), F.lit(True)))


def capabilities(tokens: DataFrame) -> DataFrame:
    """Available launchpads with their active keys, in case-insensitive order."""
    counted = active_tokens(tokens).groupBy(launchpad_of().alias("value")).agg(F.count("*").alias("active_tokens"))
    return counted.orderBy(F.lower("value"), "value")


def rank_vocabulary() -> dict:
    """Fields, orders and limits a ranking accepts."""
    return {
        "fields": RANK_FIELDS,
        "sort_orders": SORT_ORDERS,
        "default_limit": RANK_DEFAULT_LIMIT,
        "maximum_limit": RANK_MAX_LIMIT,
    }


def validate_rank_args(arguments: dict, launchpads: Sequence[str] | None = None) -> dict:
    """Checked arguments with defaults filled in. ``launchpads`` are the values on offer, when known."""
    if not isinstance(arguments, dict):
        raise RankArgumentError("arguments must be a mapping")
    extra = [name for name in arguments if name not in RANK_ARGUMENTS]
    if extra:
        raise RankArgumentError(f"unknown arguments: {sorted(extra)}")
    checked = {"sort_by": "market_cap", "sort_order": "desc", "limit": RANK_DEFAULT_LIMIT, "launchpad": None, **arguments}
    if checked["sort_by"] not in RANK_FIELDS:
        raise RankArgumentError("sort_by is no rankable field")
    if checked["sort_order"] not in SORT_ORDERS:
        raise RankArgumentError("sort_order is neither asc nor desc")
    limit = checked["limit"]
    if type(limit) is not int or not 0 < limit <= RANK_MAX_LIMIT:
        raise RankArgumentError(f"limit is no whole number from 1 to {RANK_MAX_LIMIT}")
    wanted = checked["launchpad"]
    if wanted is not None:
        if not isinstance(wanted, str) or wanted.strip() == "":
            raise RankArgumentError("launchpad is empty or no text")
        checked["launchpad"] = wanted.strip()
        if launchpads is not None and checked["launchpad"].lower() not in {v.lower() for v in launchpads}:
            raise RankArgumentError("launchpad is not on offer")
    return checked


def rank_tokens(
    tokens: DataFrame,
    sort_by: str = "market_cap",
    sort_order: str = "desc",
    limit: int = RANK_DEFAULT_LIMIT,
    launchpad: str | None = None,
) -> DataFrame:
    """Top rows by one field with ``rank`` and ``matched_count``; ties by key ascending in both directions.

    Rows without the sort field do not match. Spark keeps ``limit`` rows per task and merges those.
    """
    args = validate_rank_args(
        {"sort_by": sort_by, "sort_order": sort_order, "limit": limit, "launchpad": launchpad}
    )
    matching = active_tokens(tokens).where(F.col(args["sort_by"]).isNotNull())
    if args["launchpad"] is not None:
        matching = matching.where(F.lower(launchpad_of()) == args["launchpad"].lower())
    field = F.col(args["sort_by"])
    order = [field.desc() if args["sort_order"] == "desc" else field.asc(), F.col("mint").asc()]
    top = matching.orderBy(*order).limit(args["limit"])
    matched = matching.agg(F.count("*").alias("n")).scalar()
    return top.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"), matched.alias("matched_count"), *RANK_OUTPUT
    )


def _label() -> Column:
    return F.lower(F.concat_ws("\0", *[F.coalesce(F.col(c), F.lit("")) for c in ("symbol", "name", "mint")]))


def _search_fields() -> list[Column]:
    return [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("mint", "symbol", "name")]


def search_tokens(tokens: DataFrame, text: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Active keys whose key, symbol or name contains the text; an exact key (case-sensitive) comes first.

    Then by market cap, unknown last, then by label in binary order of its lower-case form.
    """
    raw = (text or "").strip()
    needle = raw.lower()
    hit = F.lit(False)
    for field in _search_fields():
        hit = hit | field.contains(needle)
    wanted = F.lit(bool(raw) and limit >= 1)
    order = [
        (F.col("mint") == raw).desc(),
        finite(F.col("market_cap")).desc_nulls_last(),
        _label().asc(),
    ]
    top = tokens.where("tracking_enabled").where(hit & wanted).orderBy(*order).limit(max(limit, 0))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


GRAM = 3
# Bytes of query texts up to which they are sent to every task.
SENT_BYTES = 8 << 20


def _grams(text: Column) -> Column:
    """Substrings of one to ``GRAM`` characters; every start gives one of each length that still fits."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)))
    sized = [F.transform(starts, lambda i: F.substring(text, i, F.lit(n))) for n in range(1, GRAM + 1)]
    # Near the end a longer gram is a shorter one again; removing duplicates takes care of it.
    return F.concat(*sized)


def batch_search(tokens: DataFrame, queries: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """``search_tokens`` for a table of ``query_id, text``, without pairing every query with every key.

    A text that contains the query contains the query's leading gram, so both sides meet on grams (up to three
    characters) in an equi-join and the substring test only runs on those pairs. Queries of at most ``SENT_BYTES`` are
    sent to the keys, whose grams are then never exchanged; more are joined by an exchange of both sides. Spark must not
    choose here: it takes the grams for as small as the file of the keys. Keys are dealt out before they become many grams.
    Each task keeps its best ``limit`` rows per query before the exchange.
    """
    needle = F.lower("_raw")
    asked = stored(
        queries.select("query_id", strip(F.col("text")).alias("_raw"))
        .where("_raw <> ''")
        .select("query_id", "_raw", needle.alias("_needle"))
        .withColumn("_gram", F.substring("_needle", 1, GRAM))
    )
    size = asked.agg(F.coalesce(F.sum(F.octet_length("_raw")), F.lit(0))).first()[0]
    per_field = [_grams(field) for field in _search_fields()]
    keys = tokens.where("tracking_enabled").select("mint", "symbol", "name", finite(F.col("market_cap")).alias("market_cap"))
    dealt = keys.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    indexed = dealt.select(
        "*",
        F.explode(F.array_distinct(F.concat(*per_field))).alias("_gram"),
    )
    hit = F.lit(False)
    for field in _search_fields():
        hit = hit | field.contains(F.col("_needle"))
    order = Window.partitionBy("query_id").orderBy(
        (F.col("mint") == F.col("_raw")).desc(), F.col("market_cap").desc_nulls_last(), _label().asc()
    )
    return (
        indexed.join(asked.hint("broadcast" if size <= SENT_BYTES else "merge"), "_gram")
        .where(hit)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select("query_id", "rank", "mint", "symbol", "name", "market_cap")
    )


def rank_result(
    tokens: DataFrame,
    sort_by: str = "market_cap",
    sort_order: str = "desc",
    limit: int = RANK_DEFAULT_LIMIT,
    launchpad: str | None = None,
) -> DataFrame:
    """One row for one ranking, also when nothing matches: the checked arguments, matched and returned counts, and the rows
    in rank order. A launchpad that no active key has is an error, as any other bad argument."""
    args = validate_rank_args({"sort_by": sort_by, "sort_order": sort_order, "limit": limit, "launchpad": launchpad})
    if args["launchpad"] is not None:
        offered = capabilities(tokens).where(F.lower("value") == args["launchpad"].lower()).limit(1).collect()
        validate_rank_args(args, [r.value for r in offered])
    top = rank_tokens(tokens, **args)
    # At most ``RANK_MAX_LIMIT`` rows.
    listed = F.array_sort(F.collect_list(F.struct("rank", *RANK_OUTPUT)))
    found = top.agg(F.max("matched_count").alias("matched"), F.count("*").alias("returned_count"), listed.alias("tokens"))
    return found.select(
        F.lit(args["sort_by"]).alias("sort_by"),
        F.lit(args["sort_order"]).alias("sort_order"),
        F.lit(args["launchpad"]).cast("string").alias("launchpad"),
        F.coalesce("matched", F.lit(0).cast("bigint")).alias("matched_count"),
        "returned_count",
        "tokens",
    )
