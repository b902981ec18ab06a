"""Admission, collapsing of polls into source versions, and the merges into history and registry.

All merges of one batch rest on one fold per key (``fold_versions``); the registry is joined with one row per polled
key, never with the polls themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import schemas
from tidemark.config import RETENTION_HOURS
from tidemark.functions.coerce import boolean_only, instant, source_time, text_of
from tidemark.functions.joins import split_ready

DESCRIPTIVE = (
    "dev",
    "name",
    "symbol",
    "decimals",
    "icon",
    "twitter",
    "website",
    "token_program",
    "created_at",
    "first_pool_id",
    "first_pool_created_at",
    "mint_authority_disabled",
    "freeze_authority_disabled",
)


def new_keys(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct candidates the registry does not know; a retired key is known and stays retired."""
    return candidates.select("mint").distinct().join(registry.select("mint"), "mint", "left_anti")


def blank_rows(keys: DataFrame) -> DataFrame:
    """Registry rows of freshly admitted keys."""
    defaults = {"tracking_enabled": F.lit(True), "priority": F.lit(1)}
    columns = [
        F.col("mint") if f.name == "mint" else defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.REGISTRY.fields
    ]
    return keys.select(*columns)


def admit(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry extended by the new candidates."""
    return registry.unionByName(blank_rows(new_keys(candidates, registry)), allowMissingColumns=True)


def discovery_tick(candidates: DataFrame, registry: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """Per source: occurrences, distinct keys, and keys it was first to bring in.

    ``candidates`` has ``source, source_order, mint``. Within one batch a new key belongs to its earliest source. With
    ``sources``, those that were asked, each of them has a row, also one that brought nothing.
    """
    per_source = candidates.groupBy("mint", "source", "source_order").agg(F.count("*").alias("n"))
    earliest = per_source.groupBy("mint").agg(F.min("source_order").alias("first_order"))
    owners = new_keys(candidates, registry).join(earliest, "mint")
    owned = owners.select("mint", F.col("first_order").alias("source_order"), F.lit(1).alias("is_new"))
    ticks = (
        per_source.join(owned, ["mint", "source_order"], "left")
        .groupBy("source")
        .agg(
            F.sum("n").alias("candidate_occurrences"),
            F.count("*").alias("unique_candidates"),
            F.coalesce(F.sum("is_new"), F.lit(0)).cast("bigint").alias("new_keys"),
        )
    )
    if sources is None:
        return ticks
    counts = [c for c in ticks.columns if c != "source"]
    empty = candidates.sparkSession.createDataFrame([(s, 0, 0, 0) for s in sources], ["source", *counts])
    return ticks.unionByName(empty).groupBy("source").agg(*[F.sum(c).alias(c) for c in counts])


def collapse_versions(polls: DataFrame) -> DataFrame:
    """One row per ``(id, updated_at text)``: payload and instant of the first arrival, newest poll instant."""
    return polls.groupBy("id", "updated_at").agg(
        F.min_by(F.struct("payload", "observed_at"), "arrival_seq").alias("_first"),
        F.max("observed_at").alias("last_polled_at"),
        F.min("arrival_seq").alias("arrival_seq"),
    ).select(
        F.col("id").alias("mint"),
        "updated_at",
        source_time(F.col("updated_at")).alias("source_time"),
        F.col("_first.payload").alias("payload"),
        F.col("_first.observed_at").alias("observed_at"),
        "last_polled_at",
        "arrival_seq",
    )


def tag_versions(versions: DataFrame, registry: DataFrame) -> DataFrame:
    """Versions with ``is_newer``: strictly newer source time than the registry holds, or none held."""
    held = registry.select("mint", source_time(F.col("source_updated_at")).alias("_held"))
    newer = F.col("_held").isNull() | (F.col("source_time") > F.col("_held"))
    return (
        versions.join(split_ready(held, "mint"), "mint", "left")
        .withColumn("is_newer", F.coalesce(newer, F.lit(False)))
        .drop("_held")
    )


def newer_versions(versions: DataFrame, registry: DataFrame) -> DataFrame:
    return tag_versions(versions, registry).where("is_newer").drop("is_newer")


def append_snapshots(newer: DataFrame, snapshots: DataFrame, polls: DataFrame | None = None) -> DataFrame:
    """Rows to add to the history: first version per ``(mint, observed_at)``, unless that instant is stored already.

    Only the stored instants inside the batch's own time range are compared, so old history is pruned by the scan. The
    range is that of ``polls`` if given: it is read off without working the versions out a second time.
    """
    offered = newer.groupBy("mint", "observed_at").agg(
        F.min_by("payload", F.struct("source_time", "arrival_seq")).alias("payload")
    )
    range_of = newer if polls is None else polls
    bounds = range_of.agg(F.struct(F.min("observed_at").alias("lo"), F.max("observed_at").alias("hi"))).scalar()
    stored = snapshots.select("mint", "observed_at").where(F.col("observed_at").between(bounds["lo"], bounds["hi"]))
    return offered.join(stored, ["mint", "observed_at"], "left_anti")


def describe_payload(payload: Column) -> Column:
    """Descriptive registry columns of one payload."""

    def text(path: str) -> Column:
        return text_of(payload, path)

    created = text("$.createdAt")
    fields = {
        "dev": text("$.dev"),
        "name": text("$.name"),
        "symbol": text("$.symbol"),
        "decimals": F.try_variant_get(payload, "$.decimals", "int"),
        "icon": text("$.icon"),
        "twitter": text("$.twitter"),
        "website": text("$.website"),
        "token_program": text("$.tokenProgram"),
        "created_at": source_time(created),
        "first_pool_id": text("$.firstPool.id"),
        "first_pool_created_at": source_time(text("$.firstPool.createdAt")),
        "mint_authority_disabled": boolean_only(payload, "$.audit.mintAuthorityDisabled"),
        "freeze_authority_disabled": boolean_only(payload, "$.audit.freezeAuthorityDisabled"),
    }
    return F.struct(*[fields[name].alias(name) for name in DESCRIPTIVE])


def fold_versions(tagged: DataFrame) -> DataFrame:
    """One row per polled key with everything the registry needs from this batch."""
    order = F.struct("source_time", "arrival_seq")
    newest_order = F.when(F.col("is_newer"), order)
    folded = tagged.groupBy("mint").agg(
        F.max_by("payload", order).alias("_payload"),
        F.max("last_polled_at").alias("polled_at"),
        F.min(F.when(F.col("is_newer"), F.col("observed_at"))).alias("first_new_at"),
        F.max_by("observed_at", newest_order).alias("newest_at"),
        F.max_by("updated_at", newest_order).alias("newest_updated_at"),
    )
    return folded.withColumn("described", describe_payload(F.col("_payload"))).drop("_payload")


def _described() -> dict[str, Column]:
    """Registry columns after enrichment, over a registry row joined with a folded row (``_known``: row existed)."""
    fill = F.col("name").isNull() & F.col("described").isNotNull()
    columns = {
        name: F.when(fill, F.col(f"described.{name}")).otherwise(F.col(name)) for name in DESCRIPTIVE
    }
    columns["tracking_enabled"] = F.when(F.col("_known"), F.col("tracking_enabled")).otherwise(F.lit(True))
    columns["priority"] = F.when(F.col("_known"), F.col("priority")).otherwise(F.lit(1))
    return columns


def _poll_facts() -> dict[str, Column]:
    """Registry columns after the poll merge, over the same joined row."""
    return {
        "first_observed_at": F.coalesce("first_observed_at", "first_new_at"),
        "last_polled_at": F.greatest("last_polled_at", "polled_at"),
        "last_changed_at": F.coalesce("newest_at", "last_changed_at"),
        "source_updated_at": F.coalesce("newest_updated_at", "source_updated_at"),
    }


def _registry_row(joined: DataFrame, changed: dict[str, Column]) -> DataFrame:
    return joined.select(*[changed.get(name, F.col(name)).alias(name) for name in schemas.REGISTRY.names])


def enrich_registry(registry: DataFrame, folded: DataFrame) -> DataFrame:
    """Fill the descriptive columns of rows that have no name yet; add rows for unknown keys."""
    known = registry.withColumn("_known", F.lit(True))
    return _registry_row(known.join(folded.select("mint", "described"), "mint", "full_outer"), _described())


def merge_poll_facts(registry: DataFrame, folded: DataFrame) -> DataFrame:
    """Advance the poll facts. A poll without a newer version moves ``last_polled_at`` only."""
    return _registry_row(registry.join(folded.drop("described"), "mint", "left"), _poll_facts())


def changed_registry_rows(registry: DataFrame, folded: DataFrame) -> DataFrame:
    """Enrichment and poll merge in one join, for the polled keys only."""
    known = registry.withColumn("_known", F.lit(True))
    return _registry_row(folded.join(known, "mint", "left"), {**_described(), **_poll_facts()})


def enriched_keys(registry: DataFrame, folded: DataFrame) -> DataFrame:
    """Polled keys whose descriptive columns this batch fills."""
    named = registry.where("name IS NOT NULL").select("mint")
    return folded.select("mint").join(named, "mint", "left_anti")


def store_summary(enriched: DataFrame, newer: DataFrame, appended: DataFrame) -> DataFrame:
    """Counts of one batch: enriched keys, snapshots offered, snapshots really added."""
    tagged = (
        enriched.select(F.lit("enriched").alias("what"))
        .unionByName(newer.select(F.lit("offered").alias("what")))
        .unionByName(appended.select(F.lit("added").alias("what")))
    )
    return tagged.agg(
        F.count_if(F.col("what") == "enriched").alias("enriched_keys"),
        F.count_if(F.col("what") == "offered").alias("offered_snapshots"),
        F.count_if(F.col("what") == "added").alias("added_snapshots"),
    )


def expire_snapshots(snapshots: DataFrame, as_of, hours: float = RETENTION_HOURS) -> DataFrame:
    """History inside the retention period; exactly ``hours`` old is kept."""
    return snapshots.where(F.col("observed_at") >= _cutoff(as_of, hours))


def expired_count(snapshots: DataFrame, as_of, hours: float = RETENTION_HOURS) -> DataFrame:
    return snapshots.agg(F.count_if(F.col("observed_at") < _cutoff(as_of, hours)).alias("deleted"))


def _cutoff(as_of, hours: float) -> Column:
    return instant(as_of) - F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600:.6f})")


def strip_private(payloads: DataFrame) -> DataFrame:
    """Landed items without the two bookkeeping columns; all other columns survive."""
    return payloads.drop("_observed_at", "_last_polled_at")
