"""Landed poll responses to stored tables, micro-batch by micro-batch, with the lifecycle cycle on top.

A micro-batch reads the state before it and writes the rows it changed (see ``sources.tables``); the checkpoint of the stream
says which batches are done. Pacing of cycles rests on instants in the stored rows, so a batch that is tried again decides as
it did before. History is written first; a cycle starts from the evidence of the closed hours and reads the typed columns of
the open ones, and works its outcome out once: registry, cursors and evidence come from the same rows.
"""

from __future__ import annotations

import threading
from datetime import datetime, timedelta, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import RETENTION_HOURS, RuleConfig
from tidemark.operators import evidence_state as es, ingest, lifecycle as lc
from tidemark.plans.cycle import ingest_batch
from tidemark.sources import tables

# Flush, lifecycle and retention intervals in seconds.
FLUSH_SECONDS = 2
CYCLE_SECONDS = 15
RETENTION_SECONDS = 3600
#: Rows up to this much older than a cycle are looked at in history; then their hour is folded into the carried evidence.
OPEN_SECONDS = 3600


def replace_rows(base: DataFrame, changed: DataFrame) -> DataFrame:
    """``base`` with the rows of ``changed`` in place of those with the same key."""
    return base.join(changed.select("mint"), "mint", "left_anti").unionByName(changed)


def process_batch(
    spark: SparkSession,
    root: str,
    polls: DataFrame,
    batch: int | None = None,
    as_of: datetime | None = None,
    cfg: RuleConfig = RuleConfig(),
    writer: str = "direct",
    retention_hours: float | None = RETENTION_HOURS,
) -> int:
    """Ingest one batch of polls; with ``as_of`` also run one lifecycle cycle over the result. Gives the number of its rows.

    A numbered batch of a writer may be repeated as long as it is the writer's newest: it comes to the same state.
    """
    tag = tables.Tag.of(writer, batch)
    before = tables.clock(spark, root, tag)
    # Ingest alone needs the polled keys only; a cycle looks at every active key.
    polled = polls.select(F.col("id").alias("mint")).distinct() if as_of is None else None
    registry = tables.read_registry(spark, root, polled, tag)
    span = polls.agg(F.min("observed_at").alias("lo"), F.max("observed_at").alias("hi")).first()
    ingested = ingest_batch(polls, registry, tables.read_snapshots(spark, root, span.lo, span.hi))
    # Registry and history come from the same versions: they are worked out once, and lie on disk since a batch may be large.
    versions = ingested.versions.persist(StorageLevel.DISK_ONLY)
    changed = ingested.registry.persist()
    held = [changed, versions]
    try:
        tables.append_history(root, ingested.snapshots, tag)
        outputs, closed_until = {"registry": changed}, before.closed_until
        late = None
        if closed_until is not None and span.lo is not None and _utc(span.lo) < _utc(closed_until):
            own = tables.read_measures(spark, root, span.lo, span.hi, only=tag)
            late = own.where(F.col("observed_at") < F.lit(closed_until)).select("mint").distinct().persist()
            held.append(late)
        if as_of is not None:
            closed_until, cycle, kept = _cycle(spark, root, tag, replace_rows(registry, changed), changed, late, closed_until, as_of, cfg, retention_hours)
            outputs.update(cycle)
            held += kept
        elif late is not None:
            outputs["evidence"] = _folded_anew(spark, root, tag, changed, late, closed_until, cfg)
        return tables.write_state(spark, root, outputs, tag, as_of, closed_until)
    finally:
        for frame in held:
            frame.unpersist()


def _utc(at: datetime) -> datetime:
    return at.astimezone(timezone.utc)


def _folded_anew(spark: SparkSession, root: str, tag: tables.Tag, registry: DataFrame, keys: DataFrame, until: datetime, cfg: RuleConfig) -> DataFrame:
    """Evidence state of some keys from the whole closed history: few keys, and only when rows come late or facts change."""
    history = tables.read_measures(spark, root, until=until).where(F.col("observed_at") < F.lit(until))
    return es.fold(registry, history.join(keys, "mint", "left_semi"), cfg, tables.read_rule_state(spark, root, keys, tag))


def _cycle(spark, root, tag, current, changed, late, closed_until, as_of, cfg, retention_hours) -> tuple[datetime | None, dict, list]:
    """What one lifecycle cycle changes, the instant up to which evidence is folded after it, and the frames it holds."""
    cursors = tables.read_rule_state(spark, root, tag=tag)
    since = None if retention_hours is None else as_of - timedelta(hours=retention_hours)
    state = tables.read_evidence(spark, root, tag)
    anew = es.outdated(current, state, cfg, cursors, since)
    anew = (anew if late is None else anew.unionByName(late).distinct()).persist()
    held = [anew]
    refolded = None
    if closed_until is not None and not anew.isEmpty():
        refolded = _folded_anew(spark, root, tag, current, anew, closed_until, cfg).persist()
        held.append(refolded)
        state = state.join(anew, "mint", "left_anti").unionByName(refolded)
    recent = tables.read_measures(spark, root, since=closed_until)
    outcome = lc.outcome(es.carried(current, state, recent, as_of, cfg, cursors, since), cfg).persist()
    held.append(outcome)

    candidates = lc.candidates(outcome)
    touched = changed.select("mint").unionByName(candidates.select("mint")).distinct()
    moved = lc.clean_scans(outcome).withColumnRenamed("scanned_through", "_moved")
    outputs = {
        "registry": lc.apply_retirement(current, candidates, as_of).join(touched, "mint", "left_semi"),
        "rule_state": moved.join(cursors, ["mint", "rule_key"], "left")
        .where(F.col("scanned_through").isNull() | (F.col("_moved") > F.col("scanned_through")))
        .select("mint", "rule_key", F.col("_moved").alias("scanned_through")),
    }
    closing = (_utc(as_of) - timedelta(seconds=OPEN_SECONDS)).replace(minute=0, second=0, microsecond=0)
    if closed_until is None or closing > _utc(closed_until):
        folded = es.fold(current, recent.where(F.col("observed_at") < F.lit(closing)), cfg, cursors).persist()
        held.append(folded)
        if not folded.isEmpty():
            rows = es.merge(state.join(folded.select("mint"), "mint", "left_semi"), folded)
            rest = None if refolded is None else refolded.join(folded.select("mint"), "mint", "left_anti")
            outputs["evidence"] = rows if rest is None else rows.unionByName(rest)
            return closing, outputs, held
    if refolded is not None:
        outputs["evidence"] = refolded
    return closed_until, outputs, held


def admit_candidates(spark: SparkSession, root: str, candidates: DataFrame, batch: int | None = None, writer: str = "discovery") -> int:
    """Bring discovered keys (column ``mint``) into the stored registry; known ones, retired ones too, stay as they are."""
    tag = tables.Tag.of(writer, batch)
    offered = candidates.select("mint").where("mint IS NOT NULL").distinct()
    fresh = ingest.blank_rows(ingest.new_keys(offered, tables.read_registry(spark, root, offered, tag)))
    return tables.write_state(spark, root, {"registry": fresh}, tag)


def run_collector(
    spark: SparkSession,
    source: str,
    root: str,
    checkpoint: str,
    cfg: RuleConfig = RuleConfig(),
    cycle_s: float | None = CYCLE_SECONDS,
    max_files: int | None = None,
    available_now: bool = False,
    retention_s: float | None = RETENTION_SECONDS,
    retention_hours: float = RETENTION_HOURS,
) -> StreamingQuery:
    """Start the stream. ``root`` and ``checkpoint`` must lie on storage all executors share.

    A cycle runs when the newest poll is at least ``cycle_s`` after the previous cycle; None turns cycles off. Snapshots are
    expired when the cut-off has moved by ``retention_s``; None turns that off.
    """
    tables.init_tables(spark, root)
    reader = spark.readStream.schema(tables.schemas.POLL_RESPONSES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    polls = tables.explode_polls(reader.json(source))

    started, query = threading.Event(), []

    def write(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        batch = batch.persist()
        try:
            newest = batch.agg(F.max("observed_at").alias("at")).first().at
            writer = str(query[0].id)  # the checkpoint's own name: a fresh one is another query
            last = tables.clock(spark, root, tables.Tag(writer, batch_id))
            due = cycle_s is not None and newest is not None
            due = due and (last.cycle_at is None or newest - last.cycle_at >= timedelta(seconds=cycle_s))
            process_batch(spark, root, batch, batch_id, newest if due else None, cfg, writer, retention_hours)
            if retention_s is not None and newest is not None and _passes(retained, newest, retention_s):
                tables.retain(spark, root, newest, retention_hours)
        finally:
            batch.unpersist()

    retained: list[datetime] = []
    writer = polls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{FLUSH_SECONDS} seconds"}
    query.append(writer.trigger(**trigger).start())
    started.set()
    return query[0]


def _passes(last: list[datetime], now: datetime, every_s: float) -> bool:
    """Whether ``every_s`` have passed since the last pass, noted here; a pass too many does no harm."""
    if last and now - last[0] < timedelta(seconds=every_s):
        return False
    last[:] = [now]
    return True
