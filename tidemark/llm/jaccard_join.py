"""Similarity join of word shingles: size-banded tiles, bitmap signatures, exact intersections.

A text's set holds the 64-bit hashes of its distinct shingles; equal sets are one node (told apart by a 64-bit hash of the
set). Sets that link are of similar size, so sizes are cut into bands; a set works in its own band and, where it is large
enough to link into it, as a visitor in the next. Two linking sets of a band differ in at most d shingles, d known from the
band's largest size. The hash range is cut into more than d segments: some segments have the same content in both, and more
of them than a set can have empty ones, or else the set's empty segments count too. Sets with one content of a segment are a
tile, and every link lies in some tile.

Small tiles list their pairs. A crowded tile first ties all members to its most central one; what is then still apart inside
it is compared in slices of bounded size: hashed bitmaps give an upper bound on the overlap by counting bits, and only pairs
above the bound are kept. All kept pairs meet their sets once, where sorted arrays are intersected exactly. Nothing is
dropped or capped: classes are those of all links.

Texts without words have an empty set and stand alone. Rows without an id take part; a class is named by its smallest id, or
by none. Repeated rows give repeated results.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import Rows, checkpointed, id_text, map_text, mixed, pack, partitions, picked, record, stored, unpack
from tidemark.llm.components import connected_components
from tidemark.llm.substrings import runs

WIDTH = 4
PERCENT = 85
#: Members of a tile that are still compared pair by pair, and members of a slice of a larger one.
FEW = 8
SLICE = 2000
#: A content with this part of a block's sets (and no fewer than FEW) never gathers its members in one bucket.
OFTEN = 0.01
#: Entries (key, node) packed at once inside a task.
BLOCK_ENTRIES = 1_500_000
#: Bitmap bits for each shingle, before rounding up to a power of two.
BITS = 4
NO_ID = -(1 << 63)
_SHORT = np.uint64(0x6A09E667F3BCC909)


# ---- sets, bands and segments ---------------------------------------------------------------------------------------------


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than ``width`` are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return mixed(np.array([xxh64_intdigest(b" ".join(words), len(words))], np.uint64) ^ _SHORT)
    return np.unique(runs(words, width))


def node_of(hashes: np.ndarray) -> int:
    return xxh64_intdigest(hashes.tobytes(), len(hashes) & 0xFFFFFFFF)


def links(a: int, b: int, both: int, percent: int) -> bool:
    return (100 + percent) * both >= percent * (a + b)


@cache
def bands(percent: int) -> tuple[int, ...]:
    """First sizes of the bands. Smaller sets than the first link to their equals only."""
    edges = [-(-percent // (100 - percent))] if percent < 100 else [1 << 40]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2, edges[-1] * 100 // percent + 1))
    return tuple(edges)


@cache
def segments(band: int, percent: int) -> tuple[int, int]:
    """Number of segments of a band and how many of them two linking sets have alike at the least."""
    top = bands(percent)[band + 1] - 1
    apart = 2 * top * (100 - percent) // (100 + percent)
    alike = 3 + apart // 12
    return apart + alike, alike


@cache
def _inner_edges(count: int) -> np.ndarray:
    return np.arange(1, count, dtype=np.uint64) * np.uint64((1 << 64) // count)


def tile_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of all tiles of a set."""
    edges, size, out = bands(percent), len(hashes), []
    if size < edges[0]:
        return np.empty(0, np.uint64)
    own = bisect_right(edges, size) - 1
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(hashes, out=sums[1:])
    for band in (own, own + 1) if 100 * size >= percent * edges[own + 1] else (own,):
        count, alike = segments(band, percent)
        cut = np.empty(count + 1, np.int64)
        cut[0], cut[-1] = 0, size
        cut[1:-1] = np.searchsorted(hashes, _inner_edges(count))
        keys = mixed((sums[cut[1:]] - sums[cut[:-1]]) ^ mixed(np.arange(count, dtype=np.uint64) + np.uint64((band + 1) << 40)))
        empty = cut[1:] == cut[:-1]
        out.append(keys if np.count_nonzero(empty) >= alike else keys[~empty])
    return np.concatenate(out)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Hashed bitmap with a power of two of bits."""
    width = 1 << max(6, (BITS * len(hashes) - 1).bit_length())
    out = np.zeros(width, np.uint8)
    out[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def overlap_bound(bits: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """No set behind ``others`` shares more shingles with the set behind ``bits``: a bit that only one side has costs it a shingle."""
    both = np.bitwise_count(others & bits).sum(axis=-1, dtype=np.int64)
    mine = size - (int(np.bitwise_count(bits).sum()) - both)
    return np.minimum(mine, sizes - (np.bitwise_count(others).sum(axis=-1, dtype=np.int64) - both))


# ---- tiles ------------------------------------------------------------------------------------------------------------------


class _Block:
    """Rows and tile entries of one task; equal sets give their entries once."""

    def __init__(self):
        self.ids, self.hashes, self.nodes, self.sizes = [], [], [], []
        self.keys, self.of, self.known, self.held = [], [], {}, 0

    def add(self, i: int | None, text: bytes | None, width: int, percent: int) -> None:
        own = shingles(text, width)
        node = node_of(own) if len(own) else 0
        self.ids.append(i)
        self.hashes.append(42 if text is None else xxh64_intdigest(text, 42))
        self.nodes.append(node)
        self.sizes.append(len(own))
        if len(own) and node not in self.known:
            self.known[node] = len(own)
            keys = tile_keys(own, percent)
            self.keys.append(keys)
            self.of.append(np.full(len(keys), len(self.nodes) - 1, np.uint32))
            self.held += len(keys)
        self.held += 8

    def emit(self, buckets: int) -> pa.RecordBatch:
        nodes, sizes = np.array(self.nodes, np.uint64), np.array(self.sizes, np.uint32)
        keys = np.concatenate(self.keys) if self.keys else np.empty(0, np.uint64)
        of = np.concatenate(self.of) if self.of else np.empty(0, np.uint32)
        order = np.argsort(keys, kind="stable")
        keys, of = keys[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        count = np.diff(np.append(first, len(keys)))
        often = count > max(FEW, OFTEN * len(self.known))
        crowd = np.repeat(often, count)
        lone = ~crowd
        lone[first] = True  # of a crowd one member goes to the bucket, marked
        own = TaskContext.get().partitionId() % buckets
        named = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        parts, blocks = [own], [b"D" + pack(ids, named, np.array(self.hashes, np.uint64), nodes, sizes)]
        if crowd.any():
            parts.append(own)
            blocks.append(b"C" + pack(keys[crowd], nodes[of[crowd]]))
        keys, of, crowd = keys[lone], of[lone], crowd[lone]
        cut = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        for b in range(buckets):
            if cut[b] < cut[b + 1]:
                some = slice(cut[b], cut[b + 1])
                parts.append(b)
                blocks.append(b"K" + pack(keys[some], nodes[of[some]], sizes[of[some]], crowd[some]))
        return record({"part": (parts, pa.int32()), "block": (blocks, pa.binary())})


def _pairs(groups: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of similar sizes inside each row of a matrix of members."""
    left, right = (np.array(x) for x in zip(*combinations(range(groups.shape[1]), 2)))
    a, b = groups[:, left].ravel(), groups[:, right].ravel()
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    keep = 100 * small.astype(np.int64) >= percent * large.astype(np.int64)
    return nodes[a[keep]], nodes[b[keep]]


def _rows(kind: int, x, y, n=0, tile=0) -> pa.RecordBatch:
    size = len(x)
    full = lambda v, t: pa.array(v if hasattr(v, "__len__") else np.full(size, v), t)
    return pa.RecordBatch.from_arrays([full(kind, pa.int32()), full(x, pa.int64()), full(y, pa.int64()), full(n, pa.int64()), full(tile, pa.int64())], names=["kind", "x", "y", "n", "tile"])


DOC, PAIR, CROWD = 0, 1, 2


def tiles(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, x, y, n, tile): rows (id, node, set size, text hash), pairs of nodes of small tiles, and (node, tile) of crowded ones."""
    buckets = partitions(docs.sparkSession)

    def split(batches: Rows) -> Rows:
        block = _Block()
        for ids, texts in id_text(batches):
            for i, text in zip(ids, texts):
                block.add(i, text, width, percent)
                if block.held >= BLOCK_ENTRIES:
                    yield block.emit(buckets)
                    block = _Block()
        if block.ids:
            yield block.emit(buckets)

    def meet(batches: Rows) -> Rows:
        held = [[] for _ in range(4)]
        for batch in batches:
            for packed in batch.column(1):
                raw = packed.as_py()
                arrays = unpack(raw[1:])
                if raw[:1] == b"D":
                    ids, named, hashes, nodes, sizes = arrays
                    some = sizes > 0
                    yield _rows(DOC, pa.array(ids, pa.int64(), mask=~named), pa.array(nodes.view(np.int64), pa.int64(), mask=~some), sizes.astype(np.int64), hashes.view(np.int64))
                elif raw[:1] == b"C":
                    yield _rows(CROWD, arrays[1].view(np.int64), 0, tile=arrays[0].view(np.int64))
                else:
                    for into, a in zip(held, arrays):
                        into.append(a)
        if not held[0]:
            return
        keys, nodes, sizes, crowd = (np.concatenate(h) for h in held)
        order = np.lexsort((nodes, keys))
        keys, nodes, sizes, crowd = keys[order], nodes[order], sizes[order], crowd[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(new | np.concatenate([[True], nodes[1:] != nodes[:-1]]))
        crowd = np.maximum.reduceat(crowd, first)
        keys, nodes, sizes = keys[first], nodes[first].view(np.int64), sizes[first]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(first, len(keys)))
        crowded = np.maximum.reduceat(crowd, first) | (count > FEW)
        found = [_pairs(first[(count == m) & ~crowded][:, None] + np.arange(m), nodes, sizes, percent) for m in range(2, FEW + 1)]
        a, b = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        if len(a):
            once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            yield _rows(PAIR, a[once], b[once])
        of = np.flatnonzero(np.repeat(crowded, count))
        if len(of):
            yield _rows(CROWD, nodes[of], 0, tile=keys[of].view(np.int64))

    blocks = map_text(docs, split, "part int, block binary", id_col, text_col).repartitionById(buckets, "part")
    return blocks.mapInArrow(meet, "kind int, x long, y long, n long, tile long")


def _live_sets(docs: DataFrame, rows: DataFrame, live: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, n, bits, hashes) of the wanted nodes, made anew from one row of each."""
    own_id = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    one = rows.join(live, "node").groupBy("node").agg(F.min(F.struct(own_id.alias("id"), "text_hash")).alias("r")).select("r.id", "r.text_hash")
    texts = picked(docs, id_col, text_col).select(own_id.alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    # Repeated rows meet in the join's own partitions: this takes no exchange of its own.
    texts = texts.join(checkpointed(one), ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"]).select("id", "text")

    def run(batches: Rows) -> Rows:
        for _, chunk in id_text(batches):
            sets = [shingles(t, width) for t in chunk]
            yield record(
                {
                    "node": (np.array([node_of(s) for s in sets], np.uint64).view(np.int64), pa.int64()),
                    "n": ([len(s) for s in sets], pa.int64()),
                    "bits": ([bitmap(s).tobytes() for s in sets], pa.binary()),
                    "hashes": ([s.tobytes() for s in sets], pa.binary()),
                }
            )

    return stored(texts.mapInArrow(run, "node long, n long, bits binary, hashes binary"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: bit counts first, then the exact size of the intersection."""

    def run(batches: Rows) -> Rows:
        for batch in batches:
            a, b, keep = batch.column(0).to_numpy(), batch.column(1).to_numpy(), []
            bits, hashes = [batch.column(k) for k in (2, 3)], [batch.column(k) for k in (4, 5)]
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(c[k].as_py(), np.uint64) for c in bits)
                words = min(len(x), len(y))
                left, right = hashes[0][k].as_py(), hashes[1][k].as_py()
                m, n = len(left) // 8, len(right) // 8
                bound = overlap_bound(folded(x, words), m, folded(y, words)[None], np.array([n]))
                if links(m, n, int(bound[0]), percent):
                    x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                    at = np.searchsorted(x, y)
                    at[at == m] = 0
                    if links(m, n, int(np.count_nonzero(x[at] == y)), percent):
                        keep.append(k)
            yield record({"a": (a[keep], pa.int64()), "b": (b[keep], pa.int64())})

    right = sets.select(F.col("node").alias("b"), F.col("bits").alias("bits_b"), F.col("hashes").alias("hashes_b"))
    left = sets.select(F.col("node").alias("a"), F.col("bits").alias("bits_a"), F.col("hashes").alias("hashes_a"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "bits_a", "bits_b", "hashes_a", "hashes_b")
    return both.mapInArrow(run, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _centred(crowd: DataFrame) -> DataFrame:
    """Every member of a crowded tile with its most central one: that which shares most tiles with most others."""
    sizes = crowd.groupBy("tile").agg(F.count("*").alias("m"))
    weight = checkpointed(crowd.join(sizes, "tile").groupBy("node").agg(F.sum("m").alias("weight")))
    centre = crowd.join(weight, "node").groupBy("tile").agg(F.max(F.struct("weight", "node")).alias("c")).select("tile", F.col("c.node").alias("a"))
    return crowd.join(checkpointed(centre), "tile").filter("a != node").select("a", F.col("node").alias("b"))


def _still_apart(crowd: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, slice_size: int = SLICE) -> DataFrame:
    """Pairs of different classes inside crowded tiles whose overlap bound reaches the threshold."""
    placed = checkpointed(crowd.join(classes, "node", "left").select("tile", "node", F.coalesce("root", "node").alias("root")))
    parts = placed.groupBy("tile", "root").agg(F.count("*").alias("n")).groupBy("tile")
    open_ = parts.agg(F.sum("n").alias("m"), F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    several = [F.ceil(n / slice_size).cast("int") for n in (F.col("m") - F.col("main.n"), F.col("m"))]
    open_ = checkpointed(open_.select("tile", F.col("main.root").alias("main"), several[0].alias("asking"), several[1].alias("asked")))
    rows = placed.join(open_, "tile").withColumn("stray", F.col("root") != F.col("main"))
    dealt = F.xxhash64("node")
    every = [F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("asking", "asked")]
    kept = ["tile", "node", "root", "stray"]
    targets = rows.select(*kept, F.lit(False).alias("asks"), every[0].alias("i"), F.pmod(dealt, F.col("asked")).cast("int").alias("j"))
    queries = rows.filter("stray").select(*kept, F.lit(True).alias("asks"), F.pmod(dealt, F.col("asking")).cast("int").alias("i"), every[1].alias("j"))
    full = targets.unionByName(queries).join(sets.select("node", "n", "bits"), "node")

    def compare(group: pa.Table) -> pa.Table:
        columns = {c: group.column(c).to_numpy() for c in ("node", "root", "stray", "asks", "n")}
        bits = [np.frombuffer(b, np.uint64) for b in group.column("bits").to_pylist()]
        words = min(map(len, bits))
        matrix = np.stack([folded(b, words) for b in bits])
        target, a, b = np.flatnonzero(~columns["asks"]), [], []
        node, root, n = (columns[c][target] for c in ("node", "root", "n"))
        stray = columns["stray"][target]
        others = matrix[target]
        for k in np.flatnonzero(columns["asks"]):
            me, size = columns["node"][k], columns["n"][k]
            keep = (root != columns["root"][k]) & (~stray | (me < node)) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
            some = np.flatnonzero(keep)
            if len(some):
                bound = overlap_bound(matrix[k], int(size), others[some], n[some])
                hit = node[some[(100 + percent) * bound >= percent * (n[some] + size)]]
                a.append(np.full(len(hit), me))
                b.append(hit)
        return pa.table({"a": pa.array(np.concatenate(a) if a else [], pa.int64()), "b": pa.array(np.concatenate(b) if b else [], pa.int64())})

    return full.groupBy("tile", "i", "j").applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", slice_size: int = SLICE) -> DataFrame:
    """(doc_id, n_shingles, component_id): every row with the smallest id reachable over links, itself included."""
    found = stored(tiles(docs, width, percent, id_col, text_col))
    rows = found.filter(F.col("kind") == DOC).select(F.col("x").alias("doc_id"), F.col("y").alias("node"), "n", F.col("tile").alias("text_hash"))
    crowd = checkpointed(found.filter(F.col("kind") == CROWD).select("tile", F.col("x").alias("node")).distinct())
    pairs = found.filter(F.col("kind") == PAIR).select(F.col("x").alias("a"), F.col("y").alias("b"))
    pairs = stored(_ordered(pairs.union(_centred(crowd))))
    live = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowd.select("node")).distinct()
    sets = _live_sets(docs, rows, live, width, id_col, text_col)

    roots = checkpointed(connected_components(verified(pairs, sets, percent)))
    apart = stored(_ordered(_still_apart(crowd, roots, sets, percent, slice_size)))
    if not apart.isEmpty():
        own = apart.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        more = verified(apart, stored(sets.join(own, "node", "left_semi")), percent)
        edges = roots.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = checkpointed(connected_components(edges.union(more)))

    first = checkpointed(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first")))
    rooted = first.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = checkpointed(rooted.join(least, "root").select("node", "component_id"))
    out = rows.join(named, "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
