"""Hierarchical Pitman-Yor language model with Chinese-restaurant seating sampled by Gibbs sweeps.

Three levels: a uniform base, one restaurant for single words, and ``CONTEXTS`` restaurants for the word after a hashed
previous word, all of which share the word restaurant as parent: its customers are their tables. Each word's customers in a
restaurant are taken up and seated again in sequence, and predictive probabilities are averaged over the sweeps after the
first ones.

Tokens meet in buckets by word. A word's tables in all contexts, and so its place in the parent, are then known in one
bucket; what a bucket needs of the contexts is one pair of numbers each, a table of fixed size. Words with a noticeable
share of all tokens are dealt by word and context slice, and their totals travel with that table. All counts cover every
learning document. Words are told apart by 64-bit hashes.

Null and empty texts consist of their end. Rows without an id are scored and never learnt from. Every row is its own
document, so repeated rows are learnt and scored as often as they stand. Without learning tokens all words are equally
likely (probability one).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import Rows, frequent_keys, id_text, map_text, member, mixed, pack, partitions, record, stored, task_counts, unpack

CONTEXTS = 1 << 15
#: Parts that a frequent word is dealt in, and the share of a bucket's mean load that makes it frequent.
SLICES = 64
FREQUENT_LOAD = 0.05
FOLDS, HELD_OUT = 7, 2
SWEEPS, DROPPED = 6, 2
STRENGTH = 1.0
#: Tokens packed at once inside a task.
BLOCK_TOKENS = 2_000_000
#: Customers of one dish that are seated one by one; the rest follow in runs of growing length.
SINGLY = 32
_END, _START = np.uint64(0x5F3C9A1E7B2D4C68), np.uint64(0xA17E4B95D3086F2C)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def learns(i: int | None) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % FOLDS != HELD_OUT


def token_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the lower-cased words and of the end."""
    words = (text or b"").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = _END
    return out


def contexts(tokens: np.ndarray) -> np.ndarray:
    before = np.concatenate([[_START], tokens[:-1]])
    return (mixed(before) & np.uint64(CONTEXTS - 1)).astype(np.uint16)


def _dealt(words: np.ndarray, ctx: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Keys whose order keeps words (frequent ones: their slices) and buckets together."""
    keys = mixed(words)
    often = member(words, frequent)
    keys[often] = mixed(keys[often] + (ctx[often] % SLICES + 1).astype(np.uint64) * _PRIME)
    return keys


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _starts(changed: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], changed]))


class _Tokens:
    """Tokens of one task until they are packed."""

    def __init__(self):
        self.words, self.ctx, self.docs, self.rows, self.held = [], [], [], [], 0

    def add(self, text: bytes | None, row: tuple[int, int | None]) -> None:
        tokens = token_hashes(text)
        self.words.append(tokens)
        self.ctx.append(contexts(tokens))
        self.docs.append(np.full(len(tokens), len(self.rows), np.uint32))
        self.rows.append(row)
        self.held += len(tokens)

    def sorted(self, frequent: np.ndarray, buckets: int):
        words, ctx = np.concatenate(self.words), np.concatenate(self.ctx)
        keys = _dealt(words, ctx, frequent)
        order = np.argsort(keys)
        keys, words = keys[order], words[order]
        first = _starts((keys[1:] != keys[:-1]) | (words[1:] != words[:-1]))
        return words[first], _bucket(keys[first], buckets), np.diff(np.append(first, len(words))), ctx[order], order


def _learn_rows(tokens: _Tokens, frequent: np.ndarray, buckets: int) -> pa.RecordBatch:
    words, bucket, sizes, ctx, _ = tokens.sorted(frequent, buckets)
    pairs, n = np.unique(np.repeat(np.arange(len(words)), sizes) << 16 | ctx, return_counts=True)
    of_word = np.bincount(pairs >> 16, minlength=len(words))
    cuts = np.append(_starts(bucket[1:] != bucket[:-1]), len(words))
    ends = np.concatenate([[0], np.cumsum(of_word)])
    ctx, n = (pairs & 0xFFFF).astype(np.uint16), n.astype(np.uint64)
    blocks = [pack(words[a:b], of_word[a:b].astype(np.uint32), ctx[ends[a] : ends[b]], n[ends[a] : ends[b]]) for a, b in zip(cuts, cuts[1:])]
    return record({"part": (bucket[cuts[:-1]], pa.int32()), "block": (blocks, pa.binary())})


def _score_rows(tokens: _Tokens, frequent: np.ndarray, buckets: int) -> pa.RecordBatch:
    words, bucket, sizes, ctx, order = tokens.sorted(frequent, buckets)
    docs = np.concatenate(tokens.docs)[order]
    uid = np.array([r[0] for r in tokens.rows], np.int64)
    named = np.array([r[1] is not None for r in tokens.rows])
    ids = np.array([r[1] or 0 for r in tokens.rows], np.int64)
    cuts = np.append(_starts(bucket[1:] != bucket[:-1]), len(words))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    blocks = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        own, at = np.unique(docs[ends[a] : ends[b]], return_inverse=True)
        kind = np.uint16 if len(own) < 1 << 16 else np.uint32
        blocks.append(b"S" + pack(words[a:b], sizes[a:b].astype(np.uint32), ctx[ends[a] : ends[b]], at.astype(kind), uid[own], ids[own], named[own]))
    return record({"part": (bucket[cuts[:-1]], pa.int32()), "block": (blocks, pa.binary())})


def _packed(batches: Rows, rows: Callable, wanted: Callable[[int | None], bool], frequent: np.ndarray, buckets: int) -> Rows:
    tokens, number = _Tokens(), TaskContext.get().partitionId() << 36
    for ids, texts in id_text(batches):
        for i, text in zip(ids, texts):
            if wanted(i):
                tokens.add(text, (number, i))
            number += 1
            if tokens.held >= BLOCK_TOKENS:
                yield rows(tokens, frequent, buckets)
                tokens = _Tokens()
    if tokens.held:
        yield rows(tokens, frequent, buckets)


def _frequent_words(docs: DataFrame) -> np.ndarray:
    share = FREQUENT_LOAD / partitions(docs.sparkSession)

    def run(batches: Rows) -> Rows:
        yield from task_counts((token_hashes(t) for _, texts in id_text(batches) for t in texts), share)

    return frequent_keys(map_text(docs, run, "key long, n long"), share, int(1 / share))


def _merge(batches: Rows) -> Rows:
    """All counts of one bucket: words, pairs of each, contexts and customers of the pairs."""
    parts, held = set(), []
    for batch in batches:
        parts.update(batch.column(0).to_pylist())
        held += [unpack(b.as_py()) for b in batch.column(1)]
    if not held:
        return
    words, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    sizes = np.concatenate([h[1] for h in held])
    keys = np.repeat(at, sizes) << 16 | np.concatenate([h[2] for h in held])
    order = np.argsort(keys)
    keys = keys[order]
    first = _starts(keys[1:] != keys[:-1])
    customers = np.add.reduceat(np.concatenate([h[3] for h in held])[order], first)
    keys = keys[first]
    of_word = np.bincount(keys >> 16, minlength=len(words)).astype(np.uint32)
    block = b"M" + pack(words, of_word, (keys & 0xFFFF).astype(np.uint16), customers)
    yield record({"part": ([parts.pop()], pa.int32()), "block": ([block], pa.binary())})


def seat(customers: np.ndarray, mass: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each dish's customers in sequence; ``mass`` is the weight of a new table."""
    tables = np.ones(len(customers))
    at = np.flatnonzero(customers > 1)
    k = 1
    while len(at) and k < SINGLY:
        chance = mass[at] / (mass[at] + k - discount * tables[at])
        tables[at] += rng.random(len(at)) < chance
        k += 1
        at = at[customers[at] > k]
    while len(at):
        until = int(k * 1.25)
        now = np.minimum(customers[at], until) - k
        middle = k + now / 2
        tables[at] += rng.binomial(now.astype(np.int64), mass[at] / (mass[at] + middle - discount * tables[at]))
        k = until
        at = at[customers[at] > k]
    return tables


@dataclass
class Shared:
    """What every bucket needs of the others: a pair of numbers per context and frequent word, and totals."""

    frequent: np.ndarray
    often_customers: np.ndarray
    often_tables: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    tokens: float = 0.0
    words: float = 0.0
    root_tables: float = 0.0
    discount: float = 0.5
    root_discount: float = 0.5

    @property
    def unit(self) -> float:
        return 1 / (self.words + 1)

    @property
    def root_customers(self) -> float:
        return float(self.tables.sum())

    def word_chance(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        new = (STRENGTH + self.root_discount * self.root_tables) * self.unit
        return (np.maximum(customers - self.root_discount * tables, 0) + new) / (STRENGTH + self.root_customers)

    def chance(self, ctx: np.ndarray, own: np.ndarray, word_chance: np.ndarray) -> np.ndarray:
        """Predictive probability: ``own`` is what the context's restaurant has of the word after discount."""
        return (own + (STRENGTH + self.discount * self.tables[ctx]) * word_chance) / (STRENGTH + self.customers[ctx])


@dataclass
class Bucket:
    """Counts of one bucket and what the sweeps found."""

    words: np.ndarray
    of_word: np.ndarray
    ctx: np.ndarray
    customers: np.ndarray

    def __post_init__(self):
        self.at = np.repeat(np.arange(len(self.words)), self.of_word)
        self.keys = self.at << 16 | self.ctx
        self.customers = self.customers.astype(np.int64)
        self.word_customers = np.bincount(self.at, self.customers, len(self.words))

    def guess(self, discount: float) -> np.ndarray:
        return np.where(self.customers > 1, np.ceil(self.customers**discount), 1.0)

    def with_frequent(self, values: np.ndarray, shared: Shared, whole: np.ndarray) -> np.ndarray:
        """Word totals, for frequent words those over all buckets."""
        often = member(self.words, shared.frequent)
        values[often] = whole[np.searchsorted(shared.frequent, self.words[often])]
        return values

    def sweep(self, shared: Shared, rng: np.random.Generator, sweeps: int = SWEEPS, dropped: int = DROPPED):
        """Averages over the later sweeps: discounted customers per pair and word probabilities; and the last tables."""
        tables = self.guess(shared.discount)
        own, word_chance = np.zeros(len(tables)), np.zeros(len(self.words))
        root = np.ones(len(self.words))
        for number in range(sweeps):
            counted = self.with_frequent(np.bincount(self.at, tables, len(self.words)), shared, shared.often_tables)
            root = seat(counted, np.full(len(counted), (STRENGTH + shared.root_discount * shared.root_tables) * shared.unit), shared.root_discount, rng)
            chance = shared.word_chance(counted, root)
            tables = seat(self.customers, (STRENGTH + shared.discount * shared.tables[self.ctx]) * chance[self.at], shared.discount, rng)
            if number >= dropped:
                own += self.customers - shared.discount * tables
                word_chance += chance
        kept = max(1, sweeps - dropped)
        return own / kept, word_chance / kept, tables, root


def _bucket_of(block: bytes) -> Bucket:
    return Bucket(*unpack(block[1:]))


_KINDS = CONTEXT, OFTEN, TOTAL = range(3)


def _sums(model: DataFrame, shared: Shared, sampled: bool) -> Shared:
    """The shared figures after a guess or after sweeps; only sums of fixed number reach the driver."""
    sent = model.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Rows) -> Rows:
        known = sent.value
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = _bucket_of(block.as_py())
                if sampled:
                    _, _, tables, root = own.sweep(known, np.random.default_rng(part))
                else:
                    tables, root = own.guess(known.discount), np.ones(len(own.words))
                often = member(own.words, known.frequent)
                of = own.at[often[own.at]]
                slot = np.searchsorted(known.frequent, own.words[of])
                word_tables = np.bincount(own.at, tables, len(own.words))[~often]
                totals = [
                    (own.customers.sum(), tables.sum()),
                    ((~often).sum(), root[~often].sum()),
                    ((own.customers == 1).sum(), (own.customers == 2).sum()),
                    ((word_tables == 1).sum(), (word_tables == 2).sum()),
                ]
                chosen = np.unique(own.ctx)
                columns = [(CONTEXT, chosen, np.bincount(own.ctx, own.customers)[chosen], np.bincount(own.ctx, tables)[chosen])]
                columns.append((OFTEN, np.unique(slot), *(np.bincount(slot, v[often[own.at]])[np.unique(slot)] for v in (own.customers, tables))))
                columns.append((TOTAL, np.arange(len(totals)), *np.array(totals, float).T))
                for kind, k, c, t in columns:
                    yield record(
                        {
                            "kind": (np.full(len(k), kind, np.int32), pa.int32()),
                            "k": (np.asarray(k, np.int64), pa.int64()),
                            "c": (np.asarray(c, float), pa.float64()),
                            "t": (np.asarray(t, float), pa.float64()),
                        }
                    )

    summed = model.mapInArrow(run, "kind int, k long, c double, t double").groupBy("kind", "k").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).toArrow()
    kind, k, c, t = (summed[x].to_numpy() for x in ("kind", "k", "c", "t"))

    def filled(which: int, size: int, values: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        out[k[kind == which]] = values[kind == which]
        return out

    n = len(shared.frequent)
    often = filled(OFTEN, n, c)
    (tokens, words, once, word_once), (_, root, twice, word_twice) = filled(TOTAL, 4, c), filled(TOTAL, 4, t)
    own = lambda a, b: float(np.clip((a + 1) / (a + 2 * b + 2), 0.1, 0.95))
    return Shared(
        shared.frequent, often, filled(OFTEN, n, t), filled(CONTEXT, CONTEXTS, c), filled(CONTEXT, CONTEXTS, t),
        tokens, words + (often > 0).sum(), root + (often > 0).sum(), own(once, twice), own(word_once, word_twice),
    )


def train(docs: DataFrame, wanted: Callable[[int | None], bool] = learns) -> tuple[DataFrame, Shared]:
    """The counts by bucket (stored), and the figures that all buckets share after the first sweeps."""
    frequent, buckets = _frequent_words(docs), partitions(docs.sparkSession)

    def run(batches: Rows) -> Rows:
        yield from _packed(batches, _learn_rows, wanted, frequent, buckets)

    packed = map_text(docs, run, "part int, block binary").repartitionById(buckets, "part")
    model = stored(packed.mapInArrow(_merge, "part int, block binary"))
    none = np.zeros(len(frequent))
    guessed = _sums(model, Shared(frequent, none, none, np.zeros(CONTEXTS), np.zeros(CONTEXTS)), sampled=False)
    return model, _sums(model, guessed, sampled=True)


def _scored(bucket: Bucket | None, shared: Shared, own: np.ndarray, word_chance: np.ndarray, blocks: Iterator[list], buckets: int) -> Rows:
    unseen = shared.word_chance(np.zeros(1), np.zeros(1))[0]
    least = np.log10(shared.tokens + shared.words + 1)
    for words, sizes, ctx, doc, uid, ids, named in blocks:
        known = np.zeros(len(words), bool)
        seen, chance = np.zeros(len(words)), np.full(len(words), unseen)
        got = np.zeros(len(ctx))
        if bucket is not None:
            at = np.minimum(np.searchsorted(bucket.words, words), len(bucket.words) - 1)
            known = bucket.words[at] == words
            seen[known] = bucket.whole[at[known]]
            chance[known] = word_chance[at[known]]
            key = np.repeat(at, sizes) << 16 | ctx
            pair = np.minimum(np.searchsorted(bucket.keys, key), len(bucket.keys) - 1)
            met = (bucket.keys[pair] == key) & np.repeat(known, sizes)
            got[met] = own[pair[met]]
        # A frequent word may have been learnt in other slices only.
        often = member(words, shared.frequent) & ~known
        if often.any():
            slot = np.searchsorted(shared.frequent, words[often])
            seen[often] = shared.often_customers[slot]
            tables = shared.often_tables[slot]
            chance[often] = np.where(seen[often] > 0, shared.word_chance(tables, np.minimum(tables, 1)), unseen)
        log = np.log10(shared.chance(ctx, got, np.repeat(chance, sizes)))
        columns = [np.bincount(doc, weights, len(uid)) for weights in (None, np.repeat(seen > 0, sizes), np.repeat(np.log10(seen + 1) - least, sizes), log)]
        part = mixed((uid >> 10).astype(np.uint64)) % np.uint64(buckets)
        for p in np.unique(part).tolist():
            of = part == p
            block = pack(uid[of], ids[of], named[of], *(c[of].astype(np.int64 if k < 2 else np.float64) for k, c in enumerate(columns)))
            yield record({"part": ([int(p)], pa.int32()), "block": ([block], pa.binary())})


def score(docs: DataFrame, model: DataFrame, shared: Shared) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    buckets = partitions(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(shared)

    def split(batches: Rows) -> Rows:
        yield from _packed(batches, _score_rows, lambda i: True, sent.value.frequent, buckets)

    def meet(batches: Rows) -> Rows:
        known, counts, blocks, part = sent.value, None, [], 0
        for batch in batches:
            for p, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                # Blocks stay packed until the counts are there.
                block = packed.as_py()
                if block[:1] == b"M":
                    counts, part = _bucket_of(block), p
                else:
                    blocks.append(block)
        own = word_chance = np.empty(0)
        if counts is not None:
            own, word_chance, _, _ = counts.sweep(known, np.random.default_rng(part))
            counts.whole = counts.with_frequent(counts.word_customers, known, known.often_customers)
        yield from _scored(counts, known, own, word_chance, (unpack(b[1:]) for b in blocks), buckets)

    def total(batches: Rows) -> Rows:
        held = [unpack(b.as_py()) for batch in batches for b in batch.column(1)]
        if not held:
            return
        uid, ids, named, *sums = (np.concatenate(column) for column in zip(*held))
        _, first, at = np.unique(uid, return_index=True, return_inverse=True)
        tokens, seen, base, found = (np.bincount(at, v, len(first)) for v in sums)
        doc_ids = [int(i) if ok else None for i, ok in zip(ids[first], named[first])]
        yield record(
            {
                "doc_id": (doc_ids, pa.int64()),
                "held_out": ([not learns(i) for i in doc_ids], pa.bool_()),
                "n_tokens": (tokens.astype(np.int64), pa.int64()),
                "n_known": (seen.astype(np.int64), pa.int64()),
                "train_tokens": (np.full(len(first), int(sent.value.tokens)), pa.int64()),
                "base_score": (base, pa.float64()),
                "score": (found, pa.float64()),
            }
        )

    schema = "part int, block binary"
    tokens = map_text(docs, split, schema).union(model.select("part", "block")).repartitionById(buckets, "part")
    partial = tokens.mapInArrow(meet, schema).repartitionById(buckets, "part")
    return partial.mapInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
