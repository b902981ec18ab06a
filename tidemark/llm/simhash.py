"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits on a ring of segments. If two fingerprints differ in at most t bits, some segment starts a chain
around the ring whose first l segments differ in at most t*l/m bits for every l. The longest part of that budget which is
zero gives the join key (consecutive segments that must be equal), the rest prunes pairs before the full Hamming check.
Equal fingerprints are one node, and keys shared by many fingerprints are linked through common neighbours at one bit, so
neither exact copies nor crowded keys produce pairs among all their members; no link is lost.

Null, empty and blank texts have fingerprint zero and link like any other. Rows without an id take part; they are
represented by the smallest id in their group, or by none. Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import DOCUMENT_COLUMNS, Rows, checkpointed, dealt_anew, id_text, map_text, record, stored
from tidemark.llm.components import connected_components

WIDTH = 3
SEED = 42
MAX_DIFF = 2
SEGMENTS = 5
#: Fingerprints on one key that are still compared pair by pair.
PAIR_LIMIT = 40
_COUNTED = 1 << 16


def fingerprint(text: bytes | None, width: int = WIDTH, seed: int = SEED) -> int:
    """Majority of the bits of all shingle hashes, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    if n == 1:
        hashes = np.array([xxh64_intdigest(b" ".join(words), seed)], dtype="<u8")
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(starts[:n].tolist(), ends[width - 1 :].tolist())
        hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in spans), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _COUNTED):
        bits = np.unpackbits(hashes[at : at + _COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash) as signed 64-bit integers; ``text_hash`` is Spark's ``xxhash64`` of the text."""

    def run(batches: Rows) -> Rows:
        for ids, texts in id_text(batches):
            prints = np.array([fingerprint(t, width, seed) for t in texts], dtype=np.uint64).view(np.int64)
            own = np.array([42 if t is None else xxh64_intdigest(t, 42) for t in texts], dtype=np.uint64).view(np.int64)
            yield record({"doc_id": (ids, pa.int64()), "fp": (prints, pa.int64()), "text_hash": (own, pa.int64())})

    return map_text(docs, run, "doc_id long, fp long, text_hash long", id_col, text_col)


def _masks(segments: int) -> list[int]:
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def _literal(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def pigeonring_links(prints: DataFrame, max_diff: int = MAX_DIFF, segments: int = SEGMENTS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(a, b): links that connect the distinct values ``fp`` exactly as all pairs within ``max_diff`` bits would.

    Pairs on keys of up to ``pair_limit`` values are listed; values on larger keys are tied to a common neighbour.
    """
    if max_diff != 2:
        raise ValueError("crowded keys are linked through values one bit away, which is exact for two bits")
    masks = _masks(segments)
    budget = [max_diff * length // segments for length in range(segments + 1)]
    exact = max(length for length in range(1, segments + 1) if budget[length] == 0)
    chains = [[masks[(start + k) % segments] for k in range(segments)] for start in range(segments)]
    equal = [sum(chain[:exact]) for chain in chains]

    keys = F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(_literal(m)).alias("key")) for i, m in enumerate(equal)])
    keyed = prints.select("fp", F.explode(keys).alias("k")).select("k.start", "k.key", "fp")
    shared = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = checkpointed(keyed.join(dealt_anew(shared, "key"), ["start", "key"]))

    few = members.filter(F.col("n") <= pair_limit)
    pairs = few.select("start", "key", F.col("fp").alias("a")).join(few.select("start", "key", F.col("fp").alias("b")), ["start", "key"]).filter("a < b")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    ring = F.lit(False)
    for start, chain in enumerate(chains):
        within = F.col("start") == start
        for length in range(exact + 1, segments):
            within &= F.bit_count(differing.bitwiseAND(_literal(sum(chain[:length])))) <= budget[length]
        ring |= within
    pairs = pairs.filter(ring).filter(F.bit_count(differing) <= max_diff).select("a", "b")

    crowd = members.filter(F.col("n") > pair_limit)
    flips = F.lit(None)
    for start, mask in enumerate(equal):
        near = [F.lit(0).cast("long")] + [_literal(1 << bit) for bit in range(64) if not mask >> bit & 1]
        flips = F.when(F.col("start") == start, F.array(*near)).otherwise(flips)
    around = crowd.select("start", "key", "fp", F.explode(flips).alias("flip")).select("start", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), "fp")
    centres = around.groupBy("start", "key", "point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    tied = around.join(centres, ["start", "key", "point"]).filter("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.union(tied)


def near_duplicates(docs: DataFrame, max_diff: int = MAX_DIFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash, component_id, root): every row with the smallest id reachable over links, itself included;
    ``root`` tells groups apart also where an id stands on the texts of several."""
    prints = stored(fingerprints(docs, id_col=id_col, text_col=text_col))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = checkpointed(connected_components(pigeonring_links(distinct.select("fp"), max_diff)).withColumnRenamed("node", "fp"))
    linked = distinct.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    grouped = linked.join(least, "root").select("fp", "component_id", "root")
    alone = distinct.join(roots.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"), F.col("fp").alias("root"))
    return prints.join(checkpointed(grouped.union(alone)), "fp").select("doc_id", "fp", "text_hash", "component_id", "root")


def representatives(docs: DataFrame, max_diff: int = MAX_DIFF) -> DataFrame:
    """One row of every group with the columns of ``docs``: that of the smallest (id, text hash), once if the row is repeated.

    Groups whose rows have no id keep one row for each of their texts.
    """
    groups = near_duplicates(docs, max_diff)
    named = groups.filter("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")
    nameless = groups.filter("component_id IS NULL").select("doc_id", "text_hash").distinct()
    keep = checkpointed(named.union(nameless).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    hashed = docs.select(*[F.col(c) for c in DOCUMENT_COLUMNS], F.xxhash64(F.col("text")).alias("_text_hash"))
    kept = hashed.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text_hash"]).select(*DOCUMENT_COLUMNS)
