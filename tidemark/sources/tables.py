"""Reading and writing the stored tables.

History is appended below ``snapshots/hour=<hour>``, at most once per key and instant, with the typed columns that rules and
projection read next to the payload. State tables (registry, cursors, carried evidence) hold changed rows: a batch writes its
rows as one slot of a ring of ``SLOTS`` directories, and the current state is the newest row per key by ``seq``, which is one
more than any number stored before. Every ``FOLD_EVERY`` batches the whole state goes to one of two base slots in turn, so a
slot of the ring holds nothing new when its turn comes again, and the number of directories stays the same for ever.

Exactly-once rests on Structured Streaming and on writes that may be repeated: the checkpoint repeats at most the newest
batch of a query, rows carry the query and batch they are of, a batch looks past its own rows and overwrites its own slot,
and history rows that are stored already are not appended again. One query writes to a root at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark import schemas
from tidemark.config import RETENTION_HOURS
from tidemark.operators import evidence_state as es
from tidemark.sources.payload import current_columns, lifecycle_columns

SLOTS, FOLD_EVERY = 64, 32
TAGS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("cycle_at", T.TimestampType()),
        T.StructField("closed_until", T.TimestampType()),
    ]
)
STATE = {
    "registry": (schemas.REGISTRY, ["mint"]),
    "rule_state": (schemas.RULE_STATE, ["mint", "rule_key"]),
    "evidence": (es.SCHEMA, ["mint"]),
}


@dataclass(frozen=True)
class Tag:
    """A batch of a query. A batch without a number is a query of its own."""

    query: str
    batch: int

    @classmethod
    def of(cls, query: str, batch: int | None = None) -> Tag:
        return cls(f"{query}-{uuid.uuid4().hex}", 0) if batch is None else cls(query, batch)

    @property
    def own(self) -> Column:
        return F.col("query").eqNullSafe(self.query) & F.col("batch").eqNullSafe(self.batch)


@dataclass(frozen=True)
class Clock:
    """What the stored rows say: the newest number, the instant of the last cycle, and up to where evidence is folded."""

    seq: int = -1
    cycle_at: datetime | None = None
    closed_until: datetime | None = None


def _loose(schema: T.StructType) -> list[T.StructField]:
    return [T.StructField(f.name, f.dataType) for f in schema]


def _state_schema(name: str) -> T.StructType:
    return T.StructType([*_loose(STATE[name][0]), *TAGS])


def _typed(snapshots: DataFrame) -> DataFrame:
    """History with the columns of its two typed views."""
    return snapshots.select("mint", "observed_at", "payload", F.struct(*lifecycle_columns()).alias("rules"), F.struct(*current_columns()).alias("view"))


@cache
def _history_schema(spark: SparkSession) -> T.StructType:
    rows = _typed(spark.createDataFrame([], T.StructType(_loose(schemas.SNAPSHOTS)))).schema
    return T.StructType([*_loose(rows), T.StructField("query", T.StringType()), T.StructField("batch", T.LongType())])


def init_tables(spark: SparkSession, root: str) -> None:
    """Create the tables empty where they do not exist yet; existing ones are left alone."""
    for name in STATE:
        spark.createDataFrame([], _state_schema(name)).write.mode("ignore").parquet(f"{root}/{name}/slot=first")
    spark.createDataFrame([], _history_schema(spark)).write.mode("ignore").parquet(f"{root}/snapshots/hour=first")


# ---- state ----------------------------------------------------------------------------------------------------------------


def _stored(spark: SparkSession, root: str, name: str, tag: Tag | None) -> DataFrame:
    """All stored rows, without those of the batch that asks. A slot that is overwritten meanwhile holds nothing new."""
    rows = spark.read.option("ignoreMissingFiles", "true").schema(_state_schema(name)).parquet(f"{root}/{name}").drop("slot")
    return rows if tag is None else rows.where(~tag.own)


def _newest(rows: DataFrame, name: str) -> DataFrame:
    key = STATE[name][1]
    values = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "seq").alias("_row")).select(*key, "_row.*")


def _read(spark: SparkSession, root: str, name: str, keys: DataFrame | None, tag: Tag | None) -> DataFrame:
    rows = _stored(spark, root, name, tag)
    if keys is not None:
        rows = rows.join(keys, "mint", "left_semi")
    return _newest(rows, name).select(*STATE[name][0].names)


def read_registry(spark: SparkSession, root: str, keys: DataFrame | None = None, tag: Tag | None = None) -> DataFrame:
    """Current registry, before the batch ``tag`` if given.

    With ``keys`` (one column ``mint``) only those rows: the keys are matched before the newest rows are worked out, so a
    small batch does not aggregate a large registry.
    """
    return _read(spark, root, "registry", keys, tag)


def read_rule_state(spark: SparkSession, root: str, keys: DataFrame | None = None, tag: Tag | None = None) -> DataFrame:
    return _read(spark, root, "rule_state", keys, tag)


def read_evidence(spark: SparkSession, root: str, tag: Tag | None = None) -> DataFrame:
    """Evidence state of the hours before ``clock(...).closed_until``."""
    return _read(spark, root, "evidence", None, tag)


def clock(spark: SparkSession, root: str, tag: Tag | None = None) -> Clock:
    marks = [_stored(spark, root, name, tag).select("seq", "cycle_at", "closed_until") for name in STATE]
    every = marks[0].unionByName(marks[1]).unionByName(marks[2])
    row = every.agg(F.coalesce(F.max("seq"), F.lit(-1)), F.max("cycle_at"), F.max("closed_until")).first()
    return Clock(*row)


def write_state(
    spark: SparkSession,
    root: str,
    outputs: Mapping[str, DataFrame],
    tag: Tag,
    cycle_at: datetime | None = None,
    closed_until: datetime | None = None,
) -> int:
    """Write the changed rows of a batch; gives its number. Repeating a batch writes the same slot again."""
    before = clock(spark, root, tag)
    seq = before.seq + 1
    if seq % FOLD_EVERY == 0:
        base = f"base{seq // FOLD_EVERY % 2}"
        for name in STATE:
            _newest(_stored(spark, root, name, tag), name).select(*_state_schema(name).names).write.mode("overwrite").parquet(f"{root}/{name}/slot={base}")
    marks = {
        "seq": F.lit(seq).cast("long"),
        "query": F.lit(tag.query),
        "batch": F.lit(tag.batch).cast("long"),
        "cycle_at": F.lit(cycle_at or before.cycle_at).cast("timestamp"),
        "closed_until": F.lit(closed_until or before.closed_until).cast("timestamp"),
    }
    for name, rows in outputs.items():
        tagged = rows.select(*STATE[name][0].names).withColumns(marks)
        tagged.write.mode("overwrite").parquet(f"{root}/{name}/slot={seq % SLOTS}")
    return seq


# ---- history --------------------------------------------------------------------------------------------------------------


def hour_of(instant: datetime) -> str:
    """The hour in UTC; an instant without a zone is local, as Spark hands them out."""
    return instant.astimezone(timezone.utc).strftime("%Y%m%d%H")


def _hour(column: str) -> Column:
    return F.date_format(F.to_utc_timestamp(column, F.current_timezone()), "yyyyMMddHH")


def _history(spark: SparkSession, root: str, since: datetime | None, until: datetime | None) -> DataFrame:
    """Stored history of a range of instants (ends included); only its hours are read."""
    schema = T.StructType([*_history_schema(spark), T.StructField("hour", T.StringType())])
    rows = spark.read.schema(schema).parquet(f"{root}/snapshots")
    if since is not None:
        rows = rows.where((F.col("hour") >= hour_of(since)) & (F.col("observed_at") >= F.lit(since.astimezone(timezone.utc))))
    if until is not None:
        rows = rows.where((F.col("hour") <= hour_of(until)) & (F.col("observed_at") <= F.lit(until.astimezone(timezone.utc))))
    return rows


def read_snapshots(spark: SparkSession, root: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    return _history(spark, root, since, until).select(*schemas.SNAPSHOTS.names)


def read_measures(
    spark: SparkSession, root: str, since: datetime | None = None, until: datetime | None = None, without: Tag | None = None, only: Tag | None = None
) -> DataFrame:
    """The stored ``lifecycle_view``; payloads are not read. ``without`` leaves out one batch, ``only`` reads one."""
    rows = _history(spark, root, since, until)
    if without is not None:
        rows = rows.where(~without.own)
    if only is not None:
        rows = rows.where(only.own)
    return rows.select("mint", "observed_at", "rules.*")


def read_current(spark: SparkSession, root: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """The stored ``current_view``; payloads are not read."""
    return _history(spark, root, since, until).select("mint", "observed_at", "view.*")


def append_history(root: str, rows: DataFrame, tag: Tag) -> None:
    """Append history rows of a batch that are not stored yet (see ``ingest.append_snapshots``)."""
    marks = {"query": F.lit(tag.query), "batch": F.lit(tag.batch).cast("long"), "hour": _hour("observed_at")}
    # One file for an hour of few rows, several for a large one.
    _typed(rows).withColumns(marks).hint("rebalance", "hour").write.mode("append").partitionBy("hour").parquet(f"{root}/snapshots")


def retain(spark: SparkSession, root: str, as_of: datetime, hours: float = RETENTION_HOURS) -> int:
    """Empty the hours that lie before the cut-off as a whole and give their number; safe to repeat. Readers that want the
    cut-off to the microsecond name it as ``since``."""
    cutoff = hour_of(as_of - timedelta(hours=hours))
    schema = _history_schema(spark)
    rows = spark.read.schema(T.StructType([*schema, T.StructField("hour", T.StringType())])).parquet(f"{root}/snapshots")
    old = [r.hour for r in rows.where(F.col("hour") < cutoff).select("hour").distinct().collect()]
    for hour in old:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{root}/snapshots/hour={hour}")
    return len(old)


# ---- landed polls ---------------------------------------------------------------------------------------------------------


def read_polls(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Landed provider responses, one row per polled item: ``id, updated_at, payload, observed_at, arrival_seq``.

    Items without text ``id`` and ``updatedAt`` cannot be keyed and are left out.
    """
    reader = spark.readStream if streaming else spark.read
    responses = reader.schema(schemas.POLL_RESPONSES).json(path)
    return explode_polls(responses)


def explode_polls(responses: DataFrame) -> DataFrame:
    items = responses.select(
        "observed_at",
        "arrival_seq",
        F.posexplode("tokens").alias("item", "token"),
    ).select(
        "observed_at",
        # Items of one response share its instant; their position keeps arrival order total.
        (F.col("arrival_seq") * F.lit(1_000_000) + F.col("item")).alias("arrival_seq"),
        F.try_parse_json("token").alias("payload"),
    )
    return items.select(
        F.try_variant_get("payload", "$.id", "string").alias("id"),
        F.try_variant_get("payload", "$.updatedAt", "string").alias("updated_at"),
        "payload",
        "observed_at",
        "arrival_seq",
    ).where("id IS NOT NULL AND updated_at IS NOT NULL")
