"""Population changes: difference of two populations, and applying a feed of events to a state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import schemas
from tidemark.functions.coerce import ratio

ADDED, UPDATED, RETIRED = "token_added", "token_updated", "token_retired"


def same_state(before: str, after: str) -> Column:
    """Equality over the fields that make a change visible; two NULLs are equal."""
    same = F.lit(True)
    for field in (*schemas.STATE_FIELDS, *schemas.DELTA_FIELDS):
        same = same & F.col(f"{before}.{field}").eqNullSafe(F.col(f"{after}.{field}"))
    return same


def numeric_changes(before: str, after: str) -> Column:
    """``MAP<field, STRUCT<absolute, percent>>``; both NULL when a side is missing, percent NULL from zero."""
    entries = []
    for field in schemas.DELTA_FIELDS:
        old, new = F.col(f"{before}.{field}").cast("double"), F.col(f"{after}.{field}").cast("double")
        absolute = new - old
        entries += [
            F.lit(field),
            F.struct(
                absolute.alias("absolute"),
                (ratio(absolute, F.abs(old)) * F.lit(100.0)).alias("percent"),
            ),
        ]
    return F.create_map(*entries)


def population_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Events ``type, mint, token, changes, reason`` that lead from one population to the next.

    Both sides are current projections with one row per key: one full outer join on the key.
    """

    def packed(tokens: DataFrame, name: str) -> DataFrame:
        return tokens.select("mint", F.struct(*schemas.TOKEN_FIELDS).alias(name))

    both = packed(previous, "prev").join(packed(current, "curr"), "mint", "full_outer")
    was = F.coalesce(F.col("prev.tracking_enabled"), F.lit(False))
    now = F.coalesce(F.col("curr.tracking_enabled"), F.lit(False))
    kind = (
        F.when(now & ~was, ADDED)
        .when(now & ~same_state("prev", "curr"), UPDATED)
        .when(was & ~now, RETIRED)
    )
    return both.withColumn("type", kind).where("type IS NOT NULL").select(
        "type",
        "mint",
        F.coalesce("curr", "prev").alias("token"),
        F.when(F.col("type") == UPDATED, numeric_changes("prev", "curr")).alias("changes"),
        F.when(F.col("type") == RETIRED, F.col("curr.disabled_reason")).alias("reason"),
    )


def apply_feed(state: DataFrame, events: DataFrame) -> DataFrame:
    """State after the events, in ``seq`` order per key.

    Additions and updates replace the row. A retirement lays its token over the row and makes it inactive; fields listed
    in the optional ``absent`` column keep the value they had. Other event types and events without key are ignored.
    Every field is one conditional newest-value fold, so a key with many events combines map-side.
    """
    if "absent" not in events.columns:
        events = events.withColumn("absent", F.lit(None).cast("array<string>"))
    known = events.where(F.col("type").isin(ADDED, UPDATED, RETIRED) & F.col("mint").isNotNull())
    retired = F.col("type") == RETIRED

    given_reason = retired & (F.coalesce("reason", F.lit("")) != "")

    folds = []
    for field in schemas.TOKEN_FIELDS[1:]:
        value = F.col(f"token.{field}")
        sets = ~(retired & F.coalesce(F.array_contains("absent", field), F.lit(False)))
        if field == "tracking_enabled":
            value, sets = F.when(retired, F.lit(False)).otherwise(value), F.lit(True)
        elif field == "disabled_reason":
            # The reason of the event comes first, then the token's own; a retirement always replaces an earlier one.
            value, sets = F.when(given_reason, F.col("reason")).otherwise(value), F.lit(True)
        at = F.when(sets, F.col("seq"))
        folds += [F.max_by(value, at).alias(field), F.max(at).alias(f"_set_{field}")]
    newest = known.groupBy("mint").agg(*folds)

    rows = state.select(*schemas.TOKEN_FIELDS).alias("s").join(newest.alias("e"), "mint", "full_outer")
    columns = [F.col("mint")]
    for field in schemas.TOKEN_FIELDS[1:]:
        column = F.when(F.col(f"e._set_{field}").isNotNull(), F.col(f"e.{field}")).otherwise(F.col(f"s.{field}"))
        columns.append(column.alias(field))
    return rows.select(*columns)


def population_stats(tokens: DataFrame) -> DataFrame:
    """Active keys and their distinct launchpads."""
    pad = F.when(F.col("launchpad") != "", F.col("launchpad")).otherwise("unknown")
    per_pad = tokens.where("tracking_enabled").groupBy(pad.alias("pad")).agg(F.count("*").alias("n"))
    return per_pad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("active"), F.count("*").alias("launchpads"))
