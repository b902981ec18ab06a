"""Exact repeated windows of words by super-k-mer partitioning.

Every window of ``window`` words has a minimiser: its smallest hashed run of ``width`` words. Consecutive windows with the
same minimiser travel together as one packed string to the bucket of that minimiser, so equal windows always meet and are
compared as text. Runs of words with a noticeable share of all text are used as minimisers only where nothing else is left,
so a common passage does not pull every text around it into one bucket; equal packed strings are merged before they
travel, and the positions merged away are known to repeat.

A window repeats if its words also start earlier: in a row with a smaller id, or earlier in the same row. Rows without an id
come first; different texts under one id are ordered by their hash, and repeated rows (same id and text) are one document
that does not repeat itself. Null, empty and short texts have no window and keep all their words.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import BLOCK_BYTES, DOCUMENT_COLUMNS, Rows, as_text, frequent_keys, id_text, map_text, member, mixed, pack, partitions, record, stored, task_counts, unpack

WINDOW = 20
WIDTH = 5
#: A run of words is common if it makes up this part of one bucket's mean load.
COMMON_LOAD = 0.05
NO_ID = -(1 << 63)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(1) << np.uint64(63)


def runs(words: list[bytes], width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words."""
    one = mixed(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = one[:n].copy()
    for k in range(1, width):
        total *= _PRIME
        total += one[k : k + n]
    return mixed(total)


def super_kmers(words: list[bytes], common: np.ndarray, window: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of every packed string."""
    hashes = runs(words, width)
    order = hashes >> np.uint64(1)
    order[member(hashes, common)] |= _HALF
    least = sliding_window_view(order, window - width + 1).argmin(axis=1)
    at = least + np.arange(len(least))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return hashes[at[first]], first, np.diff(np.append(first, len(at)))


def _common_runs(docs: DataFrame, window: int, width: int, id_col: str, text_col: str) -> np.ndarray:
    buckets = partitions(docs.sparkSession)
    share = COMMON_LOAD / buckets

    def run(batches: Rows) -> Rows:
        lists = ((t or b"").split() for _, texts in id_text(batches) for t in texts)
        yield from task_counts((runs(words, width) for words in lists if len(words) >= window), share)

    return frequent_keys(map_text(docs, run, "key long, n long", id_col, text_col), share, int(1 / share))


class _Block:
    """Packed strings of one task, merged where equal."""

    def __init__(self):
        self.ids, self.hashes, self.held = [], [], 0
        self.first: dict[bytes, int] = {}
        self.rows: list[tuple[int, int, int, int]] = []  # document, start, windows, minimiser
        self.repeats: list[tuple[int, int, int]] = []

    def add(self, i: int, text: bytes, words: list[bytes], common: np.ndarray, window: int, width: int) -> None:
        doc = len(self.ids)
        own = xxh64_intdigest(text, 42)
        own -= (1 << 64) if own >> 63 else 0
        self.ids.append(NO_ID if i is None else i)
        self.hashes.append(own)
        here = (self.ids[doc], own)
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        kmers, firsts, counts = super_kmers(words, common, window, width)
        spans = zip(kmers.tolist(), firsts.tolist(), counts.tolist(), starts[firsts].tolist(), ends[firsts + counts + window - 2].tolist())
        for kmer, start, n, a, b in spans:
            packed = line[a:b]
            known = self.first.setdefault(packed, len(self.rows))
            if known == len(self.rows):
                self.rows.append((doc, start, n, kmer))
                self.held += b - a + 60
                continue
            other = self.rows[known]
            there = (self.ids[other[0]], self.hashes[other[0]], other[1])
            if there < (*here, start):
                self.repeats.append((doc, start, n))
            elif there > (*here, start):
                self.repeats.append(other[:3])
                self.rows[known] = (doc, start, n, kmer)

    def emit(self, buckets: int) -> pa.RecordBatch:
        parts, blocks = [], []
        ids, hashes = np.array(self.ids, np.int64), np.array(self.hashes, np.int64)
        if self.rows:
            doc, start, n = (np.array(x, np.int32) for x in list(zip(*self.rows))[:3])
            kmer = np.array([r[3] for r in self.rows], np.uint64)
            texts = list(self.first)
            bucket = (mixed(kmer) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((doc, bucket))
            for of in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                own = [texts[k] for k in of.tolist()]
                size = np.fromiter(map(len, own), np.int32, len(own))
                parts.append(int(bucket[of[0]]))
                blocks.append(pack(b"K", ids[doc[of]], hashes[doc[of]], start[of], n[of], kmer[of], size, b"".join(own)))
        if self.repeats:
            doc, start, n = (np.array(x, np.int32) for x in zip(*self.repeats))
            parts.append((TaskContext.get().partitionId() * 31 + len(self.repeats)) % buckets)
            blocks.append(pack(b"R", ids[doc], hashes[doc], start, n))
        return record({"part": (parts, pa.int32()), "block": (blocks, pa.binary())})


def _windows(text: bytes, window: int) -> list[bytes]:
    words = text.split(b" ")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [text[a:b] for a, b in zip(starts, ends[window - 1 :].tolist())]


def _repeats_in_group(group: Iterable[tuple[bytes, tuple[int, int, int], int]], window: int):
    """Repeated windows among packed strings with one minimiser: (id, hash, first window, windows)."""
    firsts: dict[bytes, tuple] = {}
    for text, place, n in sorted(group, key=lambda x: x[1]):
        known = firsts.setdefault(text, (place, n))
        if known[0] != place:
            yield *place, n
    if len(firsts) > 1:
        entries = sorted((w, (*place[:2], place[2] + k)) for text, (place, _) in firsts.items() for k, w in enumerate(_windows(text, window)))
        for (before, there), (now, here) in zip(entries, entries[1:]):
            if before == now and there != here:
                yield *here, 1


def repeated_windows(docs: DataFrame, window: int = WINDOW, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, start, n): runs of windows whose words also start earlier; a missing id is ``NO_ID``."""
    common = _common_runs(docs, window, width, id_col, text_col)
    buckets = partitions(docs.sparkSession)

    def split(batches: Rows) -> Rows:
        block = _Block()
        for ids, texts in id_text(batches):
            for i, text in zip(ids, texts):
                words = (text or b"").split()
                if len(words) >= window:
                    block.add(i, text, words, common, window, width)
                    if block.held >= BLOCK_BYTES:
                        yield block.emit(buckets)
                        block = _Block()
        yield block.emit(buckets)

    def count(batches: Rows) -> Rows:
        held, found = defaultdict(list), defaultdict(list)

        def out(rows) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = {"id": pa.int64(), "text_hash": pa.int64(), "start": pa.int32(), "n": pa.int32()}
            return record({c: (v, kinds[c]) for c, v in zip(kinds, columns)})

        for batch in batches:
            for packed in batch.column(1):
                tag, *arrays = unpack(packed.as_py())
                if tag == b"R":
                    yield out(zip(*(a.tolist() for a in arrays)))
                else:
                    for k, a in enumerate(arrays):
                        held[k].append(a)
        if not held:
            return
        texts, sizes = held.pop(6), held.pop(5)
        block = np.repeat(np.arange(len(sizes)), [len(s) for s in sizes])
        starts = np.concatenate([np.cumsum(s, dtype=np.int64) - s for s in sizes])
        size = np.concatenate(sizes)
        ids, hashes, start, n, kmer = (np.concatenate(held.pop(k)) for k in range(5))
        order = np.argsort(kmer, kind="stable")
        edge = np.flatnonzero(np.diff(kmer[order])) + 1
        edge = np.concatenate([[0], edge, [len(order)]])
        several = np.flatnonzero(np.diff(edge) > 1)
        rows = []
        for a, b in zip(edge[several].tolist(), edge[several + 1].tolist()):
            of = order[a:b]
            packed = [texts[t][s : s + z] for t, s, z in zip(block[of].tolist(), starts[of].tolist(), size[of].tolist())]
            places = zip(ids[of].tolist(), hashes[of].tolist(), start[of].tolist())
            rows.extend(_repeats_in_group(zip(packed, places, n[of].tolist()), window))
            if len(rows) >= 100_000:
                yield out(rows)
                rows = []
        yield out(rows)

    blocks = map_text(docs, split, "part int, block binary", id_col, text_col).repartitionById(buckets, "part")
    return blocks.mapInArrow(count, "id long, text_hash long, start int, n int")


def _kept(text: bytes, spans: list, window: int) -> tuple[list[bytes], int]:
    words = text.split()
    if not spans:
        return words, 0
    edge = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        edge[s["start"]] += 1
        edge[s["start"] + s["n"] + window - 1] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return [words[k] for k in np.flatnonzero(keep).tolist()], len(words) - int(keep.sum())


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(text: bytes, spans: list, window: int) -> bytes:
    """The text without the words that ``_kept`` removes. What separates kept words stays as it was; a removed passage goes
    with the blanks behind it, at the end of the text with those before it."""
    found = [m.span() for m in _WORD.finditer(text)]
    edge = np.zeros(len(found) + 1, np.int64)
    for s in spans:
        edge[s["start"]] += 1
        edge[s["start"] + s["n"] + window - 1] -= 1
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
    parts = [text[: found[0][0]]] if keep else []
    for k in keep:
        a = found[k][0]
        if k + 1 < len(found):
            parts.append(text[a : found[k + 1][0] if k != keep[-1] else found[k][1]])
        else:
            parts.append(text[a:])
    return b"".join(parts)


def _joined(docs: DataFrame, window: int, width: int, columns: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs`` with the repeated windows of each row."""
    found = stored(repeated_windows(docs, window, width))
    spans = found.groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    spans = spans.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "_spans")
    keyed = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_own_id"), F.xxhash64("text").alias("_own_hash"))
    on = (F.col("_own_id") == F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    return keyed.join(spans, on, "left").select(*columns, "_spans")


def dedup_digest(docs: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): words outside repeated windows, reduced to a digest where they are made."""

    def run(batches: Rows) -> Rows:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            at = 0
            for ids, texts in id_text([batch]):
                rows = [_kept(t or b"", s, window) for t, s in zip(texts, spans[at : at + len(ids)])]
                at += len(ids)
                yield record(
                    {
                        "doc_id": (ids, pa.int64()),
                        "n_words": ([len(w) + r for w, r in rows], pa.int64()),
                        "n_removed": ([r for _, r in rows], pa.int64()),
                        "kept_sha256": ([hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in rows], pa.string()),
                    }
                )

    return _joined(docs, window, width, ("doc_id", "text")).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """``documents`` without repeated windows.

    Changed texts keep their line breaks and other blanks between kept words, with ``n_chars`` to match; texts without a repeat
    stay as they are, and a document of which nothing is left goes.
    """
    schema = docs.select(*DOCUMENT_COLUMNS).schema

    def run(batches: Rows) -> Rows:
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in DOCUMENT_COLUMNS}
            kind, texts = columns["text"].type, columns["text"].cast(pa.large_binary()).to_pylist()
            chars, keep = columns["n_chars"].to_pylist(), [True] * len(texts)
            for k, spans in enumerate(batch.column(batch.schema.get_field_index("_spans")).to_pylist()):
                if spans:
                    texts[k] = _cut(texts[k], spans, window)
                    chars[k], keep[k] = len(as_text(texts[k])), bool(texts[k])
            # Bytes as they were, also where they are no UTF-8.
            columns["text"] = pa.array(texts, pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()).view(kind)
            columns["n_chars"] = pa.array(chars, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array(keep, pa.bool_()))

    return _joined(docs, window, width, DOCUMENT_COLUMNS).mapInArrow(run, schema)
