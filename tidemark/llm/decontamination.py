"""Benchmark decontamination by templates.

Words lose their case and edge punctuation; numbers, units and names become typed placeholders. Windows of the resulting
template are hash-joined with those of the benchmark items. Per occurrence of an item in a document the slots must agree: what
the item repeats in several slots has one value in the document too, and placeholders alone never make a window, so copies
with other numbers and names are caught while texts that share a phrase are not.

A document is contaminated by an item if consistent windows cover ``RUN`` words of it or ``SHARE`` of its windows; windows that
more than ``MANY`` items share make no pair where an item has others (``telling``), and count in the pairs these make. Items
shorter than a window are one window of their own length. Items without a window (under ``SHORTEST`` words, or too few plain
ones) and items mainly in a script without spaces are also looked for literally and whole, with their own numbers and names;
below ``LITERAL`` words or characters only as a whole line, since any text may contain them. Null and empty texts match nothing. Repeated rows and repeated items give one result per (doc_id, item_id);
rows without an id are reported under a null id. Bytes that are no UTF-8 read as U+FFFD.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import DOCUMENT_COLUMNS, Rows, as_text, checkpointed, id_text, map_text, mixed, record

WINDOW = 8
SHORTEST = 5
RUN = 13
SHARE = 0.5
#: Items that may share a window before it counts as their common wording.
MANY = 8
#: Part of the values in several slots of an item that must each become one value.
CONSISTENT = 0.8
#: Words by which neighbouring windows of one occurrence may be shifted, as by a name of several words. Less than
#: ``SHORTEST``, so copies that follow each other stay apart.
DRIFT = 3
#: Words, or characters of a script without spaces, from which an item is looked for inside a line.
LITERAL = 3
#: Cells of the table of benchmark hashes that is sent to every task, whatever the size of the benchmark.
FILTER_BITS = 22
MEMO_WORDS = 300_000
# Words that stand for numbers and units.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
)
UNIT_WORDS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degrees celsius fahrenheit watt watts volt volts mph kmh".split()
)
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”‘’«»„…–—¿¡"
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(%|[a-z]{0,3})")
_PRIME = np.uint64(0x9E3779B97F4A7C15)
# Scripts without spaces: every character is a word of the literal form. Signs of arithmetic count there, other punctuation not.
_UNSPACED = "\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_LITERAL = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+|[-+*/^=<>%\u2212\u00d7\u00f7]")
_ONE_UNSPACED = re.compile(rf"[{_UNSPACED}]")
PLAIN, NUMBER, UNIT, NAME = range(4)
NOTHING = -1  # punctuation alone
_PLACEHOLDER = np.array([0, *(xxh64_intdigest(x) for x in (b"<number>", b"<unit>", b"<name>"))], np.uint64)


class Canon:
    """Per distinct word: hash, kind, capital, end of sentence and canonical form, in arrays by the word's number.

    They are given up between texts when they hold ``MEMO_WORDS`` words.
    """

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self._room(1 << 12)

    def _room(self, size: int) -> None:
        kept = len(self.known)
        old = (self.hashes, self.kinds, self.capitals, self.ends, self.lows) if kept else ()
        self.hashes, self.kinds = np.empty(size, np.uint64), np.empty(size, np.int64)
        self.capitals, self.ends, self.lows = np.empty(size, bool), np.empty(size, bool), np.empty(size, object)
        for new, values in zip((self.hashes, self.kinds, self.capitals, self.ends, self.lows), old):
            new[:kept] = values[:kept]

    @staticmethod
    def _read(word: bytes) -> tuple[int, int, bool, bool, str]:
        if word.isalpha() and word.islower():  # a to z: its own canonical form, no capital, no end
            text = word.decode()
            kind = NUMBER if text in NUMBER_WORDS else UNIT if text in UNIT_WORDS else PLAIN
            return xxh64_intdigest(word), kind, False, False, text
        text = as_text(word)
        bare = text.strip(_EDGES)
        low = bare.lower()
        if not bare:
            kind = NOTHING
        elif _NUMBER.fullmatch(low) or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNIT_WORDS:
            kind = UNIT
        else:
            kind = PLAIN
        capital = bool(bare) and bare[0].isupper() and not (len(bare) > 1 and bare.isupper())
        return xxh64_intdigest(low.encode()), kind, capital, text.rstrip("\"')]»”’")[-1:] in ".?!:", low

    def _learn(self, words: list[bytes]) -> None:
        at, end = len(self.known), len(self.known) + len(words)
        if end > len(self.hashes):
            self._room(2 * end)
        columns = zip(*map(self._read, words))
        for kept, values in zip((self.hashes, self.kinds, self.capitals, self.ends, self.lows), columns):
            kept[at:end] = values
        self.known.update(zip(words, range(at, end)))

    def template(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Template hash, kind and canonical word of every word that has more than punctuation."""
        if len(self.known) >= MEMO_WORDS:
            self.known.clear()
        words = (text or b"").split()
        found = list(map(self.known.get, words))
        if None in found:
            self._learn(list({word: None for word, code in zip(words, found) if code is None}))
            found = list(map(self.known.__getitem__, words))
        codes = np.array(found, np.int64)
        begins = np.ones(len(codes), bool)
        begins[1:] = self.ends[codes[:-1]]
        kinds = self.kinds[codes]
        kinds[(kinds == PLAIN) & self.capitals[codes] & ~begins] = NAME
        some = kinds != NOTHING
        codes, kinds = codes[some], kinds[some]
        return np.where(kinds == PLAIN, self.hashes[codes], _PLACEHOLDER[kinds]), kinds, self.lows[codes]


def window_hashes(hashes: np.ndarray, kinds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``width`` words, and whether half of it is plain words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    one = mixed(hashes)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total *= _PRIME
        total += one[k : k + n]
    plain = np.concatenate([[0], np.cumsum(kinds == PLAIN)])
    return mixed(total), 2 * (plain[width:] - plain[:n]) >= width


def _slots(kinds: np.ndarray, at: int, width: int) -> list[int]:
    return [k for k in range(at, at + width) if kinds[k] != PLAIN]


@dataclass
class Found:
    """Columns of windows to be emitted."""

    key: list
    row: list
    at: list
    width: list
    slots: list
    spots: list

    @classmethod
    def empty(cls) -> Found:
        return cls([], [], [], [], [], [])

    def add(self, row, hashes, kinds, words, keep, width) -> None:
        for at in np.flatnonzero(keep).tolist():
            self.key.append(hashes[at])
            self.row.append(row)
            self.at.append(at)
            self.width.append(width)
            spots = _slots(kinds, at, width)
            self.spots.append(spots)
            self.slots.append([words[k] for k in spots])

    def columns(self) -> dict:
        return {
            "key": (np.array(self.key, np.uint64).view(np.int64), pa.int64()),
            "at": (self.at, pa.int32()),
            "width": (self.width, pa.int32()),
            "slots": (self.slots, pa.list_(pa.string())),
        }


def literal_words(text: bytes | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash of every word of the literal form, whether a line begins there (one more entry for the end), unspaced characters."""
    words, begins = [], []
    for line in as_text(text).lower().splitlines():
        found = _LITERAL.findall(line)
        words += found
        begins += [True, *[False] * (len(found) - 1)] if found else []
    known = {w: xxh64_intdigest(w.encode()) for w in set(words)}
    unspaced = sum(map(bool, map(_ONE_UNSPACED.match, words)))
    return mixed(np.array([known[w] for w in words], np.uint64)), np.array([*begins, True], bool), unspaced


def literal_keys(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words at each position."""
    total = np.full(len(at), width, np.uint64)
    for k in range(width):
        total *= _PRIME
        total += hashes[at + k]
    return mixed(total)


def literal_items(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, first, width, item_id): items without a template window, or mainly in a script without spaces."""

    def run(batches: Rows) -> Rows:
        canon = Canon()
        for ids, texts in id_text(batches):
            out = []
            for i, text in zip(ids, texts):
                hashes, kinds, words = canon.template(text)
                width = min(window, len(words))
                literal, _, unspaced = literal_words(text)
                if len(literal) and (width < SHORTEST or not window_hashes(hashes, kinds, width)[1].any() or 2 * unspaced > len(literal)):
                    out.append((i, literal_keys(literal, np.zeros(1, np.int64), len(literal))[0], literal[0], len(literal)))
            yield record(
                {
                    "key": (np.array([x[1] for x in out], np.uint64).view(np.int64), pa.int64()),
                    "first": (np.array([x[2] for x in out], np.uint64).view(np.int64), pa.int64()),
                    "width": ([x[3] for x in out], pa.int32()),
                    "item_id": ([x[0] for x in out], pa.int64()),
                }
            )

    return map_text(benchmark, run, "key long, first long, width int, item_id long", id_col, text_col).dropDuplicates()


def literal_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, doc_id, text_hash) of runs of document words that may be a whole item of ``literal_items``.

    A bit table of first words and one of whole items, both of fixed size, leave out most others here; the join decides.
    """
    mask = (1 << FILTER_BITS) - 1
    tables = []
    for column in ("first", "key"):
        table = np.zeros(1 << FILTER_BITS, bool)
        table[[r[0] for r in items.select(F.col(column).bitwiseAND(mask)).distinct().collect()]] = True
        tables.append(np.packbits(table))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast((tables, widths))
    low = np.uint64(mask)

    def run(batches: Rows) -> Rows:
        (first, whole), widths = [np.unpackbits(t).view(bool) for t in sent.value[0]], sent.value[1]
        for ids, texts in id_text(batches):
            keys, rows = [], []
            for row, text in enumerate(texts):
                hashes, begins, _ = literal_words(text)
                starts = np.flatnonzero(first[hashes & low])
                for width in widths:
                    at = starts[starts + width <= len(hashes)]
                    if width < LITERAL:
                        at = at[begins[at] & begins[at + width]]
                    found = literal_keys(hashes, at, width)
                    found = np.unique(found[whole[found & low]])
                    keys.append(found)
                    rows += [row] * len(found)
            own = [xxh64_intdigest(t or b"", 42) for t in texts]
            yield record(
                {
                    "key": (np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64), pa.int64()),
                    "doc_id": ([ids[r] for r in rows], pa.int64()),
                    "text_hash": (np.array([own[r] for r in rows], np.uint64).view(np.int64), pa.int64()),
                }
            )

    return map_text(docs, run, "key long, doc_id long, text_hash long")


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, at, width, slots, spots, item_id, windows): the template windows of every item and how many it has."""

    def run(batches: Rows) -> Rows:
        canon = Canon()
        for ids, texts in id_text(batches):
            found, windows = Found.empty(), []
            for i, text in zip(ids, texts):
                hashes, kinds, words = canon.template(text)
                width = min(window, len(words))
                if width < SHORTEST:
                    continue
                keys, plain = window_hashes(hashes, kinds, width)
                found.add(i, keys, kinds, words, plain, width)
                windows += [int(plain.sum())] * int(plain.sum())
            yield record(found.columns() | {"spots": (found.spots, pa.list_(pa.int32())), "item_id": (found.row, pa.int64()), "windows": (windows, pa.int32())})

    return map_text(benchmark, run, "key long, at int, width int, slots array<string>, spots array<int>, item_id long, windows int", id_col, text_col).dropDuplicates(["item_id", "at", "width", "key"])


def _judged_items(items: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """``items`` with the number of items that share a window, and per item: ``own`` windows, and the first of its like."""
    spread = items.groupBy("key", "width").agg(F.countDistinct("item_id").alias("_items"))
    marked = items.join(spread, ["key", "width"])
    alike = F.transform("slots", lambda slot: F.array_position("slots", slot))
    shape = F.xxhash64(F.array_sort(F.collect_list(F.struct("at", "key", alike.alias("alike")))))
    per_item = marked.groupBy("item_id").agg(F.count_if(F.col("_items") <= many).cast("int").alias("own"), shape.alias("_shape"))
    like = Window.partitionBy("own", "_shape").orderBy("item_id")
    first = F.when(F.col("own") == 0, F.first("item_id").over(like)).otherwise(F.col("item_id"))
    return marked, per_item.select(F.col("item_id").alias("_item_id"), "own", first.alias("first_id"))


def telling(items: DataFrame, many: int = MANY) -> DataFrame:
    """The windows with ``common``: whether a window does not tell the item from others, and ``own``: how many do.

    A window of more than ``many`` items is wording they share, such as an instruction: it says that a text is of their kind,
    not which of them it holds, and would be met by every text with every item. An item that has no other windows is told by
    them; of several with the same ones, in the same order and with the same slots alike, that of the smallest id stands for
    all (``members``).
    """
    marked, per_item = _judged_items(items, many)
    kept = marked.join(per_item, marked["item_id"].eqNullSafe(per_item["_item_id"])).filter(F.col("first_id").eqNullSafe(F.col("_item_id")))
    common = (F.col("_items") > many) & (F.col("own") > 0)
    own = F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("windows"))
    return kept.select(*items.columns, common.alias("common"), own.alias("own"))


def members(benchmark: DataFrame, window: int = WINDOW, many: int = MANY) -> DataFrame:
    """(item_id, member_id) of the items for which another one stands in ``contaminated``."""
    per_item = _judged_items(checkpointed(item_windows(benchmark, window)), many)[1]
    return per_item.filter(~F.col("first_id").eqNullSafe(F.col("_item_id"))).select(F.col("first_id").alias("item_id"), F.col("_item_id").alias("member_id"))


def with_members(found: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``contaminated`` with those of the items that another one stands for."""
    like = members(benchmark).withColumnRenamed("item_id", "_first")
    other = found.join(like, found["item_id"].eqNullSafe(like["_first"]))
    return found.union(other.select(*[F.col("member_id").alias(c) if c == "item_id" else F.col(c) for c in found.columns]))


def matching_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, at, width, slots, doc_id, text_hash) of document windows that may be an item's.

    A bit table of fixed size, filled from all benchmark windows, leaves out most others here; the join decides.
    """
    cells = items.select((F.col("key").bitwiseAND((1 << FILTER_BITS) - 1)).alias("cell"), "width").distinct().collect()
    tables: dict[int, np.ndarray] = {}
    for cell, width in cells:
        tables.setdefault(width, np.zeros(1 << FILTER_BITS, bool))[cell] = True
    sent = docs.sparkSession.sparkContext.broadcast({w: np.packbits(t) for w, t in tables.items()})
    low = np.uint64((1 << FILTER_BITS) - 1)

    def run(batches: Rows) -> Rows:
        canon, bits = Canon(), {w: np.unpackbits(t).view(bool) for w, t in sent.value.items()}
        for ids, texts in id_text(batches):
            found = Found.empty()
            for row, text in enumerate(texts):
                hashes, kinds, words = canon.template(text)
                for width, table in bits.items():
                    keys, plain = window_hashes(hashes, kinds, width)
                    keep = plain & table[keys & low]
                    if keep.any():
                        found.add(row, keys, kinds, words, keep, width)
            own = [xxh64_intdigest(t or b"", 42) for t in texts]
            yield record(
                found.columns()
                | {
                    "doc_id": ([ids[r] for r in found.row], pa.int64()),
                    "text_hash": (np.array([own[r] for r in found.row], np.uint64).view(np.int64), pa.int64()),
                }
            )

    return map_text(docs, run, "key long, at int, width int, slots array<string>, doc_id long, text_hash long")


def _occurrences(met: DataFrame, pair: list[str]) -> DataFrame:
    """``met`` with the number (from 1) of the occurrence that a window belongs to, and its most frequent offset.

    Sorted offsets (document position minus item position) that lie at most ``DRIFT`` apart are one occurrence.
    """
    along = Window.partitionBy(*pair).orderBy("offset")
    begins = F.coalesce(F.col("offset") - F.lag("offset").over(along) > DRIFT, F.lit(True)).cast("long")
    numbered = met.withColumn("_begins", begins).withColumn("occurrence", F.sum("_begins").over(along)).drop("_begins")
    alike = F.count("*").over(Window.partitionBy(*pair, "offset"))
    main = F.max(F.struct("_alike", "offset")).over(Window.partitionBy(*pair, "occurrence"))
    return numbered.withColumn("_alike", alike).withColumn("main", main["offset"]).drop("_alike")


def _passed(met: DataFrame, run: int, share: float) -> DataFrame:
    """The occurrences that contaminate, from the windows of a document that are an item's."""
    pair = ["doc_id", "text_hash", "item_id"]
    met = checkpointed(_occurrences(met.withColumn("offset", F.col("at") - F.col("item_at")), pair))
    part = [*pair, "occurrence"]
    differs = F.col("doc_slots") != F.col("slots")

    def chosen(rows: DataFrame, *order: Column) -> DataFrame:
        return rows.groupBy(*part, "item_at").agg(F.min_by("doc_slots", F.struct(*order)).alias("doc_slots"), F.first("slots").alias("slots"), F.first("spots").alias("spots"), F.first("windows").alias("windows"), F.first("width").alias("width"))

    apart = chosen(met, F.abs(F.col("offset") - F.col("main")).alias("far"), differs.alias("differs"), F.col("doc_slots"))
    together = chosen(met.withColumn("occurrence", F.lit(0).cast("long")), differs.alias("differs"), F.col("doc_slots"))
    one = checkpointed(apart.union(together))
    matched = one.groupBy(*part).agg(F.count("*").alias("matched"), F.max("windows").alias("windows"), F.max("width").alias("width"))
    values = one.select(*part, F.explode(F.arrays_zip("slots", "doc_slots", "spots")).alias("s")).select(*part, F.col("s.slots").alias("slot"), F.col("s.doc_slots").alias("value"), F.col("s.spots").alias("spot"))
    met_values = values.groupBy(*part, "slot").agg(F.countDistinct("value").alias("values"), F.countDistinct("spot").alias("spots")).filter("spots > 1")
    kept = met_values.groupBy(*part).agg(F.avg((F.col("values") == 1).cast("double")).alias("consistency"))
    kept = kept.select(*[F.col(c).alias(f"_{c}") for c in part], "consistency")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in part]
    judged = matched.join(kept, same, "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
    covers = (F.col("matched") >= share * F.col("windows")) | (F.col("matched") + F.col("width") - 1 >= run)
    return judged.filter(covers & (F.col("consistency") >= CONSISTENT))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN, share: float = SHARE) -> DataFrame:
    """(doc_id, text_hash, item_id, matched, windows, consistency) for every document and item that it contains.

    Judged is every occurrence of the item by itself, and all its windows in the document together (where one is met more
    than once, the verbatim one counts), since a copy can also be torn apart; the best of what passes is reported,
    by its telling windows alone or by all of them. An item that is found literally counts as one window. Items that another
    one stands for come by ``with_members``.
    """
    items = checkpointed(telling(checkpointed(item_windows(benchmark, window))))
    hits = matching_windows(docs, items, window).select("key", "width", "doc_id", "text_hash", "at", F.col("slots").alias("doc_slots"))
    of_items = items.select("key", "width", "item_id", "windows", "own", "common", F.col("at").alias("item_at"), "slots", "spots")
    pair = ["doc_id", "text_hash", "item_id"]
    if items.filter("common").isEmpty():
        passed = _passed(hits.join(of_items.drop("own", "common"), ["key", "width"]), run, share)
    else:
        hits = checkpointed(hits)
        own = checkpointed(hits.join(of_items.filter("NOT common"), ["key", "width"]))
        # Common wording counts for the pairs that have a window of their own, which are few, and makes no pairs by itself.
        pairs = own.select(*[F.col(c).alias(f"_{c}") for c in pair]).distinct()
        wording = of_items.filter("common").withColumnsRenamed({"key": "_key", "width": "_width"})
        asked = pairs.join(wording, F.col("item_id").eqNullSafe(F.col("_item_id")))
        at = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("key", "width", "doc_id", "text_hash")]
        rest = hits.join(asked, at).select(*own.columns)
        told = _passed(own.withColumn("windows", F.col("own")).drop("own", "common"), run, share)
        passed = told.unionByName(_passed(own.unionByName(rest).drop("own", "common"), run, share))
    literal = checkpointed(literal_items(benchmark, window))
    if not literal.isEmpty():
        whole = literal_matches(docs, literal).join(literal.select("key", "item_id"), "key")
        once = [F.lit(1).cast("long").alias("matched"), F.lit(1).alias("windows"), F.lit(1.0).alias("consistency")]
        passed = passed.select(*pair, "matched", "windows", "consistency").union(whole.select(*pair, *once))
    best = passed.groupBy(*pair).agg(F.max(F.struct("matched", "consistency", "windows")).alias("b"))
    return best.select(*pair, "b.matched", "b.windows", "b.consistency")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the contaminated ones."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    own = docs.select(*DOCUMENT_COLUMNS)
    on = own["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(own["text"]) == F.col("_hash"))
    return own.join(checkpointed(found), on, "left_anti")
