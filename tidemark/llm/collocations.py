"""Phrase collocations by Rabin-Karp fingerprints.

Texts are gathered in blocks. Prefix polynomials over the bytes of a block give the hash of every word, prefix polynomials
over these the fingerprint of every run of 1 to ``max_words`` words inside a piece. Inside a block, occurrences with one
fingerprint are compared word by word with the first of them, so a block's entry (fingerprint, count) is exact. Entries meet by
fingerprint, and each block gets back one bit for every entry: whether its fingerprint has enough occurrences in all. The block
is counted again, which gives the same entries in the same order, and writes the words of those it keeps. Counts are then added
by the words themselves: fingerprints that several phrases share lose or join nothing, and no phrase whose fingerprint stays
below the wanted count is ever written out.

Pieces end at ``[.,;:!?\\x0A-\\x0D]``, words at blanks and tabs; A-Z is lower-cased. All figures are per language; a missing
language is ``und``, a null or empty text has no words, and every row counts, repeated ones as often as they stand. The rows'
ids are not used.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh64, xxh64_intdigest

from tidemark.llm.common import Rows, mixed, pack, partitions, record, stored, unpack

MAX_WORDS = 3
MIN_COUNT = 10
#: Percent of a phrase's occurrences inside one longer candidate from which the phrase is dropped.
INSIDE = 50
TOP = 2000
UNKNOWN = "und"
#: Bytes of text in a block (a longer text is a block of its own).
BLOCK_TEXT = 8 << 20
#: Bits of a fingerprint that travel: phrases that share them are told apart by their text.
KEPT_BITS = ((1 << 40) - 1) << 24
#: The bits below them, which hold a position while fingerprints are sorted.
LOW = np.uint64((1 << 24) - 1)
#: Words whose bytes are hashed or compared at once.
STEP = 1 << 17
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so that they have inverses modulo 2^64
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(BREAKS)] = 2


class Powers:
    """Powers of a base and of its inverse modulo 2^64, as many as were ever asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            factors = np.full(n, self.base)
            factors[0] = 1
            self.up = np.cumprod(factors)
            factors[1:] = self.inverse
            self.down = np.cumprod(factors)
        return self.up[:n], self.down[:n]


def spans(values: np.ndarray, powers: Powers, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Polynomial hash of ``values[first:last]`` for every pair, from one prefix sum."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[last] - sums[first]) * down[first]


@dataclass
class Words:
    """Words of a block's text: where each starts and ends, and the piece it stands in."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Words:
        kind = _KIND[data]
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = kind == 0
        turn = np.diff(inside)
        start, end = (np.flatnonzero(turn == way).astype(np.int32) for way in (1, -1))
        return cls(start, end, np.cumsum(kind == 2, dtype=np.int32)[start])


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans behind each other."""
    begin = np.cumsum(size, dtype=np.int32) - size
    return data[np.arange(int(size.sum()), dtype=np.int32) + np.repeat(start - begin, size)]


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys ascending, and where each stood, equal ones in their order. Keys with free low bits are sorted with their places in these."""
    if len(keys) <= int(LOW) and not (keys & LOW).any():
        both = np.sort(keys | np.arange(len(keys), dtype=np.uint64))
        return both & ~LOW, (both & LOW).astype(np.int32)
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where each different key of an ascending array begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def word_ids(data: np.ndarray, words: Words, hashes: np.ndarray) -> np.ndarray:
    """A number for every word such that equal numbers mean equal bytes: hashes decide, the text is compared."""
    keys, order = ordered(hashes)
    begin = firsts(keys)
    first, ids = order[begin].astype(np.int32), np.empty(len(keys), np.int32)
    ids[order] = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.append(begin, len(keys))))
    size = words.end - words.start
    rep = first[ids]
    same = size == size[rep]
    check = np.flatnonzero(same & (rep != np.arange(len(rep))))
    for some in np.split(check, range(STEP, len(check), STEP)):
        if len(some):
            equal = _gathered(data, words.start[some], size[some]) == _gathered(data, words.start[rep[some]], size[some])
            same[some] = np.logical_and.reduceat(equal, np.cumsum(size[some]) - size[some])
    odd = np.flatnonzero(~same)
    if len(odd):
        known: dict[bytes, int] = {}
        for k in odd.tolist():
            ids[k] = known.setdefault(data[words.start[k] : words.end[k]].tobytes(), len(first) + len(known))
    return ids


def word_hashes(data: np.ndarray, words: Words, powers: Powers) -> np.ndarray:
    out = np.empty(len(words.start), np.uint64)
    for a in range(0, len(out), STEP):
        start, end = words.start[a : a + STEP], words.end[a : a + STEP]
        part = data[start[0] : end[-1]].astype(np.uint64)
        out[a : a + STEP] = mixed(spans(part, powers, start - start[0], end - start[0]) + (end - start).astype(np.uint64))
    return out


def grouped(prints: np.ndarray, at: np.ndarray, ids: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, count, first word) of every different run of ``n`` words in a language, ascending by fingerprint."""
    prints, order = ordered(prints)
    at, first = at[order], firsts(prints)
    count = np.diff(np.append(first, len(prints))).astype(np.int32)
    rep = np.repeat(at[first], count)
    same = code[at] == code[rep]
    for k in range(n):
        same &= ids[at + k] == ids[rep + k]
    out = prints[first], count, at[first]
    odd = np.flatnonzero(~same)
    if len(odd):  # several phrases of one fingerprint in this block
        found: dict[tuple, list] = {}
        for k in odd.tolist():
            group = int(np.searchsorted(first, k, "right")) - 1
            count[group] -= 1
            found.setdefault((group, code[at[k]], *ids[at[k] : at[k] + n].tolist()), [prints[k], 0, at[k]])[1] += 1
        more = [np.array(c, t) for c, t in zip(zip(*found.values()), (np.uint64, count.dtype, at.dtype))]
        out = [np.concatenate([a, b]) for a, b in zip(out, more)]
        order = np.argsort(out[0], kind="stable")
        out = [a[order] for a in out]
    return tuple(out)


def _planes(values: np.ndarray) -> np.ndarray:
    """The bytes of the values by significance, which compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).reshape(-1)


def _unplaned(raw: np.ndarray, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


class Counter:
    """Counts the runs of words of a block. The same block gives the same entries in the same order, whenever it is counted."""

    def __init__(self, max_words: int, mask: int):
        self.max_words, self.mask = max_words, np.uint64(mask)
        self.bytes, self.words = Powers(_BYTE_BASE), Powers(_WORD_BASE)

    def entries(self, data: np.ndarray, words: Words, code: np.ndarray, names: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of 1, 2, ... words what ``grouped`` says of them."""
        salt = np.array([xxh64_intdigest(g, 7) for g in names], np.uint64)[code]
        hashes = word_hashes(data, words, self.bytes) & self.mask
        ids = word_ids(data, words, hashes)
        lists = []
        for n in range(1, self.max_words + 1):
            at = np.arange(max(0, len(ids) - n + 1), dtype=np.int32)
            at = at[words.piece[at] == words.piece[at + n - 1]]
            prints = mixed(spans(hashes, self.words, at, at + n) + salt[at] + np.uint64(n)) & self.mask
            lists.append(grouped(prints, at, ids, code, n))
        return lists


class Block:
    """Texts of one task until their runs of words are counted."""

    def __init__(self):
        self.texts, self.langs, self.held = [], [], 0

    def add(self, text: bytes, lang: bytes) -> None:
        self.texts.append(text)
        self.langs.append(lang)
        self.held += len(text) + 1

    def emit(self, counter: Counter, buckets: int) -> pa.RecordBatch:
        text = b"\n".join(self.texts).lower() + b"\n"
        data = np.frombuffer(text, np.uint8)
        words = Words.of(data)
        doc_end = np.cumsum([len(t) + 1 for t in self.texts])
        names = sorted(set(self.langs))
        number = {g: i for i, g in enumerate(names)}
        code = np.array([number[g] for g in self.langs], np.uint16)[np.searchsorted(doc_end, words.start, "right")]
        tagged = xxh64(text)
        tagged.update(b"\0".join(names))
        tagged.update(code.tobytes())
        block = tagged.intdigest() & ((1 << 63) - 1)

        lists = counter.entries(data, words, code, names)
        parts, blocks = [block % buckets], [b"T" + pack(text, code, *names)]
        cuts = [bucket_edges(p, buckets) for p, _, _ in lists]
        for b in range(buckets):
            arrays = []
            for (prints, count, _), cut in zip(lists, cuts):
                of = slice(cut[b], cut[b + 1])
                arrays += [_planes(np.diff(prints[of], prepend=np.uint64(0))), _planes(count[of].astype(np.uint32))]
            if any(len(a) for a in arrays):
                parts.append(b)
                blocks.append(b"E" + pack(*arrays))
        return record({"part": (parts, pa.int32()), "block": ([block] * len(parts), pa.int64()), "packed": (blocks, pa.binary())})


def bucket_of(prints: np.ndarray, buckets: int) -> np.ndarray:
    return ((prints >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_edges(prints: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of ascending fingerprints begins, and the end."""
    return np.searchsorted(bucket_of(prints, buckets), np.arange(buckets + 1))


def _entries(docs: DataFrame, max_words: int, mask: int, buckets: int) -> DataFrame:
    def run(batches: Rows) -> Rows:
        counter, block = Counter(max_words, mask), Block()
        for batch in batches:
            for lang, text in zip(batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary())):
                if len(text := text.as_py()):
                    block.add(text, lang.as_py().decode(errors="replace").encode())
                if block.held >= BLOCK_TEXT:
                    yield block.emit(counter, buckets)
                    block = Block()
        if block.texts:
            yield block.emit(counter, buckets)

    lang, text = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(run, "part int, block long, packed binary")


def _frequent(entries: DataFrame, max_words: int, min_count: int, buckets: int) -> DataFrame:
    """One bit for every entry, by block and bucket: whether its fingerprint has enough occurrences; and the blocks' texts."""

    def run(batches: Rows) -> Rows:
        prints, counts, of = [], [], []
        for batch in batches:
            for part, block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = packed.as_py()
                if raw[:1] == b"T":
                    yield record({"block": ([block], pa.int64()), "packed": ([raw], pa.binary())})
                    continue
                arrays = unpack(raw[1:])
                for p, c in zip(arrays[::2], arrays[1::2]):
                    prints.append(np.cumsum(_unplaned(p, np.uint64), dtype=np.uint64))
                    counts.append(_unplaned(c, np.uint32))
                of.append((block, part))
        if not of:
            return
        ends = np.cumsum([len(p) for p in prints])
        keys, order = ordered(np.concatenate(prints))
        first = firsts(keys)
        total = np.add.reduceat(np.concatenate(counts)[order], first, dtype=np.int64)
        keep = np.empty(len(keys), bool)
        keep[order] = np.repeat(total >= min_count, np.diff(np.append(first, len(keys))))
        bits = [np.packbits(some) for some in np.split(keep, ends[:-1])]
        packs = [b"K" + pack(np.array([part]), *bits[i * max_words : (i + 1) * max_words]) for i, (_, part) in enumerate(of)]
        yield record({"block": ([block for block, _ in of], pa.int64()), "packed": (packs, pa.binary())})

    return entries.repartitionById(buckets, "part").mapInArrow(run, "block long, packed binary")


def _flat(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words, each with one blank behind it, and where each begins."""
    inside = _KIND[data] == 0
    behind = np.zeros(len(data), bool)
    behind[1:] = inside[:-1] & ~inside[1:]
    size = words.end - words.start + 1
    return np.where(inside, data, np.uint8(32))[inside | behind], np.cumsum(size, dtype=np.int32) - size


def _phrases(raw: bytes, copies: int, packs: list[bytes], counter: Counter, buckets: int) -> Rows:
    """A block's phrases of kept fingerprints with their counts, packed by bucket; 0 words: the number of all words of a language."""
    text, code, *names = unpack(raw[1:])
    data = np.frombuffer(text, np.uint8)
    words = Words.of(data)
    lists = counter.entries(data, words, code, names)
    keeps = {}
    for packed in packs:  # equal blocks have equal bits
        part, *bits = unpack(packed[1:])
        keeps[int(part[0])] = bits
    found = []
    for n, (prints, count, at) in enumerate(lists):
        cut, keep = bucket_edges(prints, buckets), np.zeros(len(prints), bool)
        for b in np.flatnonzero(np.diff(cut)).tolist():
            keep[cut[b] : cut[b + 1]] = np.unpackbits(keeps[b][n], count=cut[b + 1] - cut[b])
        found.append((bucket_of(prints[keep], buckets), np.full(int(keep.sum()), n + 1, np.uint8), count[keep], at[keep]))
    bucket, n, count, at = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(bucket, kind="stable")
    n, count, at, edges = n[order], count[order].astype(np.int64) * copies, at[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    flat, begin = _flat(data, words)
    size = (begin + (words.end - words.start))[at + n - 1] - begin[at]
    b = 0
    while b < buckets:
        stop = max(b + 1, int(np.searchsorted(edges, edges[b] + STEP, "right")) - 1)  # buckets whose phrases are gathered at once
        own = slice(edges[b], edges[stop])
        phrases, ends = _gathered(flat, begin[at[own]], size[own]), np.append(0, np.cumsum(size[own], dtype=np.int64))
        for k in range(b, stop):
            some, (low, high) = slice(edges[k], edges[k + 1]), ends[edges[k : k + 2] - edges[b]]
            if low < high:
                yield _packed_phrases(k, n[some], count[some], code[at[some]], size[some], phrases[low:high], names)
        b = stop
    zeros = np.zeros(1, np.int32)
    for k, total in enumerate(np.bincount(code, minlength=len(names)).tolist()):
        yield _packed_phrases(xxh64_intdigest(names[k]) % buckets, zeros.astype(np.uint8), np.array([total * copies]), zeros, zeros, zeros[:0], [names[k]])


def _packed_phrases(part: int, n: np.ndarray, count: np.ndarray, code: np.ndarray, size: np.ndarray, phrases: np.ndarray, names: list[bytes]) -> pa.RecordBatch:
    used, code = np.unique(code, return_inverse=True)  # a block may have far more languages than this pack
    packed = pack(n, _planes(count.astype(np.int64)), _planes(code.astype(np.uint16)), _planes(size.astype(np.uint32)), phrases.tobytes(), *(names[k] for k in used))
    return record({"part": ([part], pa.int32()), "packed": ([packed], pa.binary())})


def _added(batches: Rows, min_count: int) -> Rows:
    """(lang, words, phrase, n) of one bucket: the blocks' counts added by the words, those that are enough."""
    tables = []
    for batch in batches:
        for packed in batch.column(1):
            n, count, code, size, phrases, *names = unpack(packed.as_py())
            lang = pa.array([g.decode() for g in names], pa.string()).take(pa.array(_unplaned(code, np.uint16)))
            offsets = np.append(0, np.cumsum(_unplaned(size, np.uint32))).astype(np.int32)
            phrase = pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets.tobytes()), pa.py_buffer(phrases))
            tables.append(pa.RecordBatch.from_arrays([lang, pa.array(n.astype(np.int32)), phrase, pa.array(_unplaned(count, np.int64))], names=["lang", "words", "phrase", "n"]))
    if tables:
        sums = pa.Table.from_batches(tables).group_by(["lang", "words", "phrase"], use_threads=False).aggregate([("n", "sum")])
        sums = sums.rename_columns({"n_sum": "n"}).select(["lang", "words", "phrase", "n"])
        enough = pc.or_(pc.equal(sums["words"], 0), pc.greater_equal(sums["n"], min_count))
        yield from sums.filter(enough).to_batches(max_chunksize=STEP)


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, mask: int = KEPT_BITS) -> DataFrame:
    """(lang, words, phrase, n): all runs of up to ``max_words`` words with at least ``min_count`` occurrences in their language,
    and with ``words`` = 0 the number of all its words. ``mask`` cuts fingerprints short, to test that collisions are harmless."""
    buckets = partitions(docs.sparkSession)

    def run(batches: Rows) -> Rows:
        counter, texts, packs = Counter(max_words, mask), defaultdict(list), defaultdict(list)
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = packed.as_py()
                if raw[:1] == b"T":
                    texts[block].append(raw)
                else:
                    packs[block].append(raw)
        if missing := packs.keys() - texts.keys():
            raise RuntimeError(f"{len(missing)} blocks were made anew with other rows: their bits mean nothing")
        for block, copies in texts.items():
            yield from _phrases(copies[0], len(copies), packs[block], counter, buckets)

    entries = _entries(docs, max_words, mask, buckets)
    kept = _frequent(entries, max_words, min_count, buckets)
    found = kept.repartition(buckets, "block").mapInArrow(run, "part int, packed binary")
    return found.repartitionById(buckets, "part").mapInArrow(lambda batches: _added(batches, min_count), "lang string, words int, phrase string, n long")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, inside: int = INSIDE, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): every language's phrases by score, the first ``top`` or all.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` all words. Products are exact decimals.
    """
    counts = stored(phrase_counts(docs, max_words, min_count))
    known = counts.filter("words > 0").select("lang", "words", "phrase", "n")
    word = F.split("phrase", " ")
    candidates = known.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), word.alias("w"))

    def run(first, size):
        return F.array_join(F.slice(F.col("w"), first, size), " ")

    cuts = candidates.select("lang", "words", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    part = known.select("lang", "phrase", "n")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in "alr")
    cuts = cuts.withColumn("top", F.lit(1_000_000).cast("decimal(7,0)") * (a * a)).withColumn("low", l * r).withColumn("score", F.expr("top div low"))
    scored = cuts.groupBy("lang", "words", "phrase", "a").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("c"))

    longer = candidates.filter("words > 2").select("lang", "words", "a", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    longer = longer.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("first"))
    longer = longer.select("lang", "a", run(F.col("first"), F.col("size")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("within").isNull() | (100 * F.col("within") < inside * F.col("a")))

    totals = counts.filter("words = 0").select("lang", F.col("n").alias("total"))
    order = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", F.col("total").alias("n"), F.col("c.score").alias("score"))
