"""Change feed and pulse series over successive populations, and windowed aggregates over event streams.

A tick looks at the population of the tick before and at nothing older: its log entry holds the sequence number and the
instant of the last kept pulse, so ticks cost the same however long the feed is. Ticks number themselves; the log remembers
which writer's batch each of the last ``KEEP_TICKS`` was, and such a batch is not published twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import ACTIVITY_WINDOW_S, PULSE_INTERVAL_S, PULSE_RETENTION_S, TELEMETRY_RETENTION_S
from tidemark.functions.coerce import seconds
from tidemark.operators.feed import population_diff
from tidemark.operators.projection import current_projection
from tidemark.operators.pulse import market_pulse
from tidemark.operators.telemetry import origin
from tidemark.sources import files, tables
from tidemark.sources.payload import current_view

BASELINE = "universe_snapshot"
#: Log entries that are kept for batches offered again.
KEEP_TICKS = 100
# Fixed value: how often a population is looked at, in seconds.
REFRESH_SECONDS = 1

LOG = T.StructType(
    [
        T.StructField("writer", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("pulse_at", T.TimestampType()),
    ]
)


@dataclass(frozen=True)
class Tick:
    """The newest tick: its number (-1 for none), the last sequence number, and the instant of the last kept pulse."""

    tick: int = -1
    sequence: int = 0
    pulse_at: datetime | None = None


def _ticks(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(tick) for tick, path in files.partitions(spark, f"{root}/ticks", "tick") if files.complete(spark, path))


def last_tick(spark: SparkSession, root: str) -> Tick:
    numbers = _ticks(spark, root)
    if not numbers:
        return Tick()
    row = spark.read.schema(LOG).parquet(f"{root}/ticks/tick={numbers[-1]}").first()
    return Tick(numbers[-1], row.sequence, row.pulse_at)


def published(spark: SparkSession, root: str, writer: str, batch: int) -> bool:
    """Whether one of the kept ticks was this writer's batch."""
    if not _ticks(spark, root):
        return False
    log = spark.read.schema(LOG).parquet(f"{root}/ticks")
    return log.where((F.col("writer") == writer) & (F.col("batch") == batch)).limit(1).count() > 0


def publish_tick(
    spark: SparkSession,
    root: str,
    population: DataFrame,
    at: datetime,
    writer: str = "direct",
    batch: int | None = None,
    every_s: float = PULSE_INTERVAL_S,
) -> Tick:
    """Append the events that lead from the previous population to this one, and a pulse if the last one is old enough.

    The first population is the baseline with sequence 1; only non-empty differences advance the sequence. The log entry is
    written last: an attempt that failed before is overwritten by the next one, which gets the same number.
    """
    before = last_tick(spark, root)
    if batch is not None and published(spark, root, writer, batch):
        return before
    number = before.tick + 1
    population.write.mode("overwrite").parquet(f"{root}/population/tick={number}")
    current = spark.read.parquet(f"{root}/population/tick={number}")
    if before.tick < 0:
        events = current.select(F.lit(BASELINE).alias("type"), "mint", F.struct(*current.columns).alias("token"))
    else:
        events = population_diff(spark.read.parquet(f"{root}/population/tick={before.tick}"), current)
    feed = f"{root}/feed/tick={number}"
    events.withColumn("sequence", F.lit(before.sequence + 1).cast("long")).write.mode("overwrite").parquet(feed)
    moved = spark.read.parquet(feed).limit(1).count() > 0
    kept = before.pulse_at is None or at.astimezone() - before.pulse_at.astimezone() >= timedelta(seconds=every_s)
    if kept:
        market_pulse(current).withColumn("ts", F.lit(at).cast("timestamp")).write.mode("overwrite").parquet(f"{root}/pulse/tick={number}")
    after = Tick(number, before.sequence + moved, at if kept else before.pulse_at)
    entry = (writer, number if batch is None else batch, after.sequence, after.pulse_at)
    spark.createDataFrame([entry], LOG).coalesce(1).write.mode("overwrite").parquet(f"{root}/ticks/tick={number}")
    for old in _ticks(spark, root)[:-KEEP_TICKS]:
        files.remove(spark, f"{root}/ticks/tick={old}")
    for tick, path in files.partitions(spark, f"{root}/population", "tick"):
        if int(tick) < number:
            files.remove(spark, path)
    return after


def feed_events(spark: SparkSession, root: str, after: int = 0) -> DataFrame:
    """Published events with a sequence above ``after``."""
    events = spark.read.option("mergeSchema", "true").parquet(f"{root}/feed")
    return events.where((F.col("tick") <= last_tick(spark, root).tick) & (F.col("sequence") > after)).drop("tick")


def pulse_history(spark: SparkSession, root: str, keep_s: float = PULSE_RETENTION_S) -> DataFrame:
    """Kept pulses of the newest period; exactly ``keep_s`` old is kept. The newest instant comes from the log."""
    at = last_tick(spark, root)
    points = spark.read.parquet(f"{root}/pulse").where(F.col("tick") <= at.tick).drop("tick")
    return points.where(F.col("ts") >= F.lit(at.pulse_at).cast("timestamp") - seconds(keep_s))


def run_observer(
    spark: SparkSession,
    store: str,
    root: str,
    checkpoint: str,
    recent_minutes: float | None = None,
    refresh_s: float = REFRESH_SECONDS,
) -> StreamingQuery:
    """Start a stream that looks at the stored tables every ``refresh_s`` and publishes feed and pulse below ``root``."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def write(beats: DataFrame, batch_id: int) -> None:
        at = beats.agg(F.max("timestamp").alias("at")).first().at
        if at is None:
            return
        current = current_view(tables.read_snapshots(spark, store))
        population = current_projection(tables.read_registry(spark, store), current, at, recent_minutes)
        publish_tick(spark, root, population, at, checkpoint, batch_id)

    writer = clock.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{refresh_s} seconds").start()


def changed_keys_windowed(events: DataFrame, window_s: float = ACTIVITY_WINDOW_S, slide_s: float = 10) -> DataFrame:
    """Approximate distinct changed keys per sliding window of an event stream with ``ts`` and ``mint``."""
    return (
        events.withWatermark("ts", f"{TELEMETRY_RETENTION_S} seconds")
        .groupBy(F.window("ts", f"{int(window_s)} seconds", f"{int(slide_s)} seconds"))
        .agg(F.approx_count_distinct("mint").alias("changed"), F.count("*").alias("events"))
    )


def lane_rates_windowed(events: DataFrame, window_s: float = ACTIVITY_WINDOW_S, slide_s: float = 10) -> DataFrame:
    """Requests per lane and sliding window of an event stream with ``at`` and ``lane``."""
    return (
        events.withWatermark("at", f"{TELEMETRY_RETENTION_S} seconds")
        .groupBy("lane", F.window("at", f"{int(window_s)} seconds", f"{int(slide_s)} seconds"))
        .agg(F.count("*").alias("requests"))
    )


def dedupe_stream(events: DataFrame) -> DataFrame:
    """Drop repeated events (type, origin, ``at`` text) that arrive within the retention period."""
    keyed = events.withColumn("_origin", F.coalesce(origin(), F.lit("")))
    return (
        keyed.withWatermark("received_at", f"{TELEMETRY_RETENTION_S} seconds")
        .dropDuplicatesWithinWatermark(["type", "_origin", "at"])
        .drop("_origin")
    )
