"""Helpers that the corpus operators share: shared folders, Arrow rows, packed blocks and their exchange."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Columns of ``documents``.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Text handled at once inside a task, and packed rows held before they are emitted.
CHUNK_BYTES = 6 << 20
BLOCK_BYTES = 48 << 20

Rows = Iterator[pa.RecordBatch]


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``. It is set here only where it is unset and the
    session is local; on a cluster a folder of the driver's machine would be lost to the executors."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, without lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows written to a table in the shared folder and read back; unlike a checkpoint it prunes columns."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """The same rows, with a whole-number key that Spark takes for a new one. A join then exchanges both sides, which lets
    AQE split a hot key; an aggregate that is partitioned by the key already would not be exchanged, and nothing split."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def partitions(spark: SparkSession) -> int:
    """Exchange width, from the session: it is set in proportion to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text alone under names of their own, so that no other column of the input can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def id_text(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list]]:
    """Ids and UTF-8 texts (None stays None) of the first two columns, some ``limit`` bytes at a time."""
    for batch in batches:
        ids, texts, held = [], [], 0
        column = batch.column(1).cast(pa.binary())
        for i, value in zip(batch.column(0).to_pylist(), column):
            text = value.as_py()
            ids.append(i)
            texts.append(text)
            held += len(text or b"")
            if held >= limit:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def as_text(text: bytes | None) -> str:
    """The characters of a text (None: empty); bytes that are no UTF-8 read as U+FFFD, as in Python's ``errors="replace"``."""
    return (text or b"").decode(errors="replace")


def record(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def map_text(docs: DataFrame, run: Callable[[Rows], Rows], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return picked(docs, id_col, text_col).mapInArrow(run, schema)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed block."""
    parts = []
    for a in arrays:
        kind, raw = ("raw", bytes(a)) if isinstance(a, (bytes, bytearray)) else (a.dtype.str, a.tobytes())
        parts += [kind.encode().ljust(4), len(raw).to_bytes(8, "little"), raw]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(block: bytes) -> list:
    data, at, out = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(data):
        kind, size = data[at : at + 4].decode().strip(), int.from_bytes(data[at + 4 : at + 12], "little")
        raw = data[at + 12 : at + 12 + size]
        out.append(raw if kind == "raw" else np.frombuffer(raw, dtype=kind))
        at += 12 + size
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that neighbouring or shared low bits do not show in the result."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def frequent_keys(hashed: DataFrame, share: float, most: int) -> np.ndarray:
    """64-bit keys with about ``share`` of all occurrences, at most ``most`` of them: they only steer how rows are dealt.

    ``hashed`` has one row per task and frequent key (``key``, ``n``) and one with key NULL and the task's total.
    """
    summed = hashed.groupBy("key").agg(F.sum("n").alias("n"))
    total = summed.filter("key IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = summed.filter(F.col("key").isNotNull() & (F.col("n") >= max(64, share * total))).orderBy(F.desc("n"), "key").limit(most)
    return np.sort(np.array([r[0] for r in rows.select("key").collect()], dtype=np.int64).view(np.uint64))


def task_counts(keys: Iterable[np.ndarray], share: float) -> Rows:
    """The frequent keys of one task, for ``frequent_keys``."""
    held = list(keys)
    every = np.concatenate(held) if held else np.empty(0, np.uint64)
    values, counts = np.unique(every, return_counts=True)
    keep = counts >= max(8, share * len(every))
    yield record(
        {
            "key": ([None, *values[keep].view(np.int64).tolist()], pa.int64()),
            "n": ([len(every), *counts[keep].tolist()], pa.int64()),
        }
    )


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in the ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values
