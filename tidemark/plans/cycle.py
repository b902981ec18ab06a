"""Compositions of several operators: one lifecycle cycle, one ingest batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.config import RuleConfig
from tidemark.operators import evidence as ev, ingest, lifecycle as lc


@dataclass(frozen=True)
class Cycle:
    evidence: DataFrame
    outcome: DataFrame
    candidates: DataFrame
    registry: DataFrame
    cursors: DataFrame
    summary: DataFrame


def lifecycle_cycle(
    registry: DataFrame,
    measures: DataFrame,
    cursors: DataFrame,
    as_of,
    cfg: RuleConfig = RuleConfig(),
    apply: bool = True,
) -> Cycle:
    """One evaluation of all rules at one instant. Without ``apply`` registry and cursors stay as they are."""
    evidence = ev.evidence(registry, measures, as_of, cfg, cursors)
    outcome = lc.outcome(evidence, cfg)
    candidates = lc.candidates(outcome)
    after, moved = registry, cursors
    if apply:
        after = lc.apply_retirement(registry, candidates, as_of)
        # The outcome has active keys only; those retired by a later rule of this cycle were still active at the scan.
        moved = ev.advance_cursor(cursors, lc.clean_scans(outcome))
    return Cycle(evidence, outcome, candidates, after, moved, lc.cycle_summary(outcome, apply))


@dataclass(frozen=True)
class Batch:
    versions: DataFrame
    registry: DataFrame
    snapshots: DataFrame
    summary: DataFrame


def ingest_batch(polls: DataFrame, registry: DataFrame, snapshots: DataFrame) -> Batch:
    """Polls of one batch to the changed registry rows and the history rows to add."""
    versions = ingest.tag_versions(ingest.collapse_versions(polls), registry)
    newer = versions.where("is_newer")
    folded = ingest.fold_versions(versions)
    updated = ingest.changed_registry_rows(registry, folded)
    added = ingest.append_snapshots(newer, snapshots, polls)
    summary = ingest.store_summary(ingest.enriched_keys(registry, folded), newer, added)
    return Batch(versions, updated, added, summary)
