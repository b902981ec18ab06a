"""Session settings the operators are designed for.

Every setting is a runtime SQL option, so ``tune`` also works on a session somebody else created. Sizes that depend on
the cluster (shuffle partitions, executor memory) are left to the caller; AQE coalesces and splits partitions.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join on the entity key is followed by an aggregate on the same key. Without this option AQE keeps a hot key in
    # one task to save the extra exchange; with it the join is split and the partial aggregate runs before the exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Two statistic names may fall together once they are in snake case.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Payloads are stored whole: their typed columns lie next to them, so no reader needs them split up by field.
    "spark.sql.variant.inferShreddingSchema": "false",
    # Per-key exact medians over at most one sample per five minutes: keep them hash based.
    "spark.sql.execution.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_OPTIONS.items():
        spark.conf.set(name, value)
    return spark


def build_session(app_name: str = "tidemark", master: str | None = None, **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**RUNTIME_OPTIONS, **options}.items():
        builder = builder.config(name, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``. A local session, whose executors are this
    machine, may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/state-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to a table in the shared folder and read back, without lineage."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
