"""Language identification, word first: log frequency of known words, else progressively shorter character n-grams.

Counts cover every learning document. What is sent to the tasks is bounded: per language the words and n-grams above a
count that at most ``WORDS`` and ``GRAMS`` of them reach, each with its counts in all languages; any other word falls back to
its n-grams, and an n-gram to a shorter one. Null, empty and letterless texts are ``und`` with score 0. Without learning documents every text is ``und``.
Ties between languages go to the first name; repeated rows give repeated results. Rows without a language are not learnt
from; rows without an id count as held out. Bytes that are no UTF-8 separate words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import DOCUMENT_COLUMNS, Rows, as_text, id_text, record, stored

#: Bounds of the model: entries per language.
WORDS = 30_000
GRAMS = 40_000
LONGEST = 4
UNKNOWN = "und"
FOLDS = 5
MEMO_WORDS = 250_000
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 250_000
SMOOTH = 0.5
#: Words that count fully towards the certainty of a score.
CERTAIN_WORDS = 24
#: Lengths of the n-grams that tell whether a text is in a learnt language at all: letters for its script, three for its words.
FIT_SIZES = (1, 3)
#: Spreads below the mean of a language at which a long text no longer counts as one of it, and those added for one n-gram;
#: the latter shrink with the root of their number.
FIT_SPREADS = 2.0
FIT_SHORT = 2.0
LEAST_SPREAD = 0.1
_WORD = re.compile(r"[^\W\d_]+")


def held_out(i: int | None, folds: int = FOLDS) -> bool:
    return i is None or zlib.crc32(str(i).encode()) % folds == 0


def words_of(text: bytes | None) -> list[str]:
    return _WORD.findall(as_text(text).lower())


def counts(docs: DataFrame, learns: Callable[[int | None], bool] = lambda i: not held_out(i), longest: int = LONGEST) -> DataFrame:
    """(lang, size, gram, n) over all learning rows; size 0 is a whole word, else the length of the n-gram."""

    def run(batches: Rows) -> Rows:
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            at, langs = 0, batch.column(2).to_pylist()
            for ids, texts in id_text([batch]):
                for i, text, lang in zip(ids, texts, langs[at : at + len(ids)]):
                    if lang is not None and learns(i):
                        found[lang].update(words_of(text))
                at += len(ids)
                if sum(map(len, found.values())) > HELD_WORDS:
                    yield from emitted(found)
                    found.clear()
        yield from emitted(found)

    def emitted(found: dict[str, Counter]) -> Rows:
        for lang, words in found.items():
            sizes: list[Counter] = [words]
            for n in range(1, longest + 1):
                part: dict[str, int] = defaultdict(int)
                for word, times in words.items():
                    padded = f"<{word}>" if n > 1 else word
                    for k in range(len(padded) - n + 1):
                        part[padded[k : k + n]] += times
                sizes.append(part)
            for size, part in enumerate(sizes):
                names, times = list(part), list(part.values())
                for k in range(0, len(names), 100_000):
                    some = names[k : k + 100_000]
                    yield record(
                        {
                            "lang": ([lang] * len(some), pa.string()),
                            "size": ([size] * len(some), pa.int32()),
                            "gram": (some, pa.string()),
                            "n": (times[k : k + 100_000], pa.int64()),
                        }
                    )

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return named.mapInArrow(run, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log frequencies by language: a row of a matrix for every known word, and for every n-gram of each length."""

    languages: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: list[dict[str, int]]
    gram_rows: list[np.ndarray]
    #: By size of FIT_SIZES, each by language: log frequency of n-grams that are not known; mean and spread over all that were learnt.
    fit: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None

    def fits(self, words: list[str]) -> np.ndarray:
        """Per word and size of FIT_SIZES: spreads from the mean, summed over its n-grams, in the language where it fits best, so
        that texts of several languages fit too; then the numbers of n-grams."""
        sums, numbers = [], []
        for n in FIT_SIZES:
            known, at, sizes, other = self.grams[n - 1].get, [], [], len(self.gram_rows[n - 1])
            least, mean, spread = self.fit[n]
            rows = (np.concatenate([self.gram_rows[n - 1], least[None]]) - mean) / np.maximum(spread, LEAST_SPREAD)
            for word in words:
                padded = f"<{word}>" if n > 1 else word
                at += [known(padded[i : i + n], other) for i in range(len(padded) - n + 1)]
                sizes.append(len(padded) - n + 1)
            sums.append(np.add.reduceat(rows[at], np.cumsum(sizes) - sizes).max(axis=1) if words else [])
            numbers.append(sizes)
        return np.array([*sums, *numbers], np.float32).T

    @classmethod
    def of(cls, languages: list[str], words: dict[str, np.ndarray], grams: list[dict[str, np.ndarray]]) -> Model:
        def matrix(rows: dict[str, np.ndarray]) -> np.ndarray:
            return np.array(list(rows.values()), np.float32).reshape(-1, max(1, len(languages)))

        number = lambda rows: {name: k for k, name in enumerate(rows)}
        return cls(languages, number(words), matrix(words), [number(g) for g in grams], [matrix(g) for g in grams])


def train(docs: DataFrame, words: int = WORDS, n_grams: int = GRAMS, longest: int = LONGEST, **options) -> Model:
    """The bounded model, from counts over all learning rows."""
    counted = stored(counts(docs, longest=longest, **options))
    # One row per language, size and count: far fewer than there are words.
    shape = counted.groupBy("lang", "size", "n").agg(F.count("*").alias("entries")).toArrow().to_pylist()
    by_kind: dict[tuple[str, int], list[tuple[int, int]]] = defaultdict(list)
    for row in shape:
        by_kind[row["lang"], row["size"]].append((row["n"], row["entries"]))
    totals, types, least = {}, {}, []
    for (lang, size), entries in by_kind.items():
        totals[lang, size] = sum(n * e for n, e in entries)
        types[lang, size] = sum(e for _, e in entries)
        room, floor = (n_grams if size else words), None
        for n, e in sorted(entries, reverse=True):
            room -= e
            if room < 0:
                break
            floor = n
        if floor is not None:
            least.append((lang, size, floor))
    languages = sorted({lang for lang, _ in by_kind})
    if not least:
        return Model.of([], {}, [{} for _ in range(longest)])
    wanted = F.lit(False)
    for lang, size, floor in least:
        wanted |= (F.col("lang") == lang) & (F.col("size") == size) & (F.col("n") >= floor)
    # An entry that one language keeps counts in all of them. Bounded by the two limits, languages and lengths, as is what is sent.
    entries = counted.filter(wanted).select("size", "gram").distinct()
    kept = counted.join(F.broadcast(entries), ["size", "gram"], "left_semi").toArrow()
    tables: list[dict[str, np.ndarray]] = [{} for _ in range(longest + 1)]
    number = {lang: k for k, lang in enumerate(languages)}
    for lang, size, gram, n in zip(*(kept[c].to_pylist() for c in ("lang", "size", "gram", "n"))):
        row = tables[size].get(gram)
        if row is None:
            row = tables[size][gram] = np.zeros(len(languages))
        row[number[lang]] = n
    fit = {}
    for size, found in enumerate(tables):
        whole = np.array([totals.get((lang, size), 0) for lang in languages], float)
        every = np.log(whole + SMOOTH * (np.array([types.get((lang, size), 0) for lang in languages]) + 1))
        if size in FIT_SIZES:
            # Over all occurrences that were learnt; those of entries that are not kept score as unknown ones do.
            held = np.array(list(found.values())).reshape(-1, len(languages))
            held = np.concatenate([np.zeros((1, len(languages))), held])
            share = held / np.maximum(whole, 1)
            share[0] = 1 - share.sum(axis=0)
            logs = np.log(held + SMOOTH) - every
            mean = (share * logs).sum(axis=0)
            fit[size] = tuple(x.astype(np.float32) for x in (logs[0], mean, np.sqrt((share * (logs - mean) ** 2).sum(axis=0))))
        for gram, row in found.items():
            found[gram] = (np.log(row + SMOOTH) - every).astype(np.float32)
    model = Model.of(languages, tables[0], tables[1:])
    model.fit = fit
    return model


class Scorer:
    """Scores of words by language; fallbacks are remembered up to a bound, for one task."""

    def __init__(self, model: Model, word_fits: np.ndarray | None = None):
        """``word_fits``: ``model.fits`` of the known words; with it ``fits`` can be asked."""
        self.model, self.width, self.fixed, self.with_fits = model, len(model.languages), len(model.words), word_fits is not None
        known = np.concatenate([model.word_rows, word_fits], axis=1) if self.with_fits else model.word_rows
        self.rows = np.concatenate([known, np.zeros((MEMO_WORDS, known.shape[1]), np.float32)])
        self.memo: dict[str, int] = {}

    def _fall_back(self, words: list[str]) -> None:
        """Rows of words that are not known: the mean over their longest n-grams that are, or nothing."""
        every, width = words, self.model.word_rows.shape[1]
        for n in range(len(self.model.grams), 0, -1):
            known, named, found, sizes, left = self.model.grams[n - 1].get, [], [], [], []
            for word in words:
                padded = f"<{word}>" if n > 1 else word
                hits = [k for k in map(known, [padded[i : i + n] for i in range(len(padded) - n + 1)]) if k is not None]
                if hits:
                    named.append(word)
                    found += hits
                    sizes.append(len(hits))
                else:
                    left.append(word)
            if named:
                starts = np.cumsum(sizes) - sizes
                at = self.fixed + len(self.memo)
                self.rows[at : at + len(named), :width] = np.add.reduceat(self.model.gram_rows[n - 1][found], starts) / np.array(sizes, np.float32)[:, None]
                self.memo.update(zip(named, range(at, at + len(named))))
            words = left
        at = self.fixed + len(self.memo)
        self.rows[at : at + len(words)] = 0
        self.memo.update(zip(words, range(at, at + len(words))))
        if self.with_fits and every:
            self.rows[[self.memo[w] for w in every], width:] = self.model.fits(every)

    def _total(self, words: list[str]) -> np.ndarray:
        """Sum over at most ``MEMO_WORDS`` words, so that all of them can be remembered at once."""
        at = list(map(self.model.words.get, words))
        if None in at:
            unknown = {w for w, k in zip(words, at) if k is None}
            unseen = unknown.difference(self.memo)
            if len(self.memo) + len(unseen) > MEMO_WORDS:
                self.memo, unseen = {}, unknown
            self._fall_back(sorted(unseen))
            memo = self.memo
            at = [memo[w] if k is None else k for w, k in zip(words, at)]
        return self.rows[at].sum(axis=0, dtype=np.float64)

    def _totals(self, text: bytes | None) -> tuple[int, np.ndarray | None]:
        """Number of words and sum of their rows; no sum without letters or languages."""
        words = words_of(text)
        if not self.width or not words or not any(map(str.isalpha, words)):
            return 0, None
        return len(words), sum(self._total(words[k : k + MEMO_WORDS]) for k in range(0, len(words), MEMO_WORDS))

    def _best(self, n: int, total: np.ndarray | None) -> tuple[str, float]:
        if total is None:
            return UNKNOWN, 0.0
        total = total[: self.width]
        sure = total * min(n, CERTAIN_WORDS) / n
        odds = np.exp(sure - sure.max())
        best = int(total.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum())

    def predict(self, text: bytes | None) -> tuple[str, float]:
        return self._best(*self._totals(text))

    def fitting(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language and score, and whether the n-grams of the text are about as frequent as usual in learnt languages."""
        n, total = self._totals(text)
        if total is None:
            return UNKNOWN, 0.0, False
        sums, numbers = total[self.width :].reshape(2, -1)
        fits = sums / numbers >= -(FIT_SPREADS + FIT_SHORT / np.sqrt(numbers))
        return *self._best(n, total), bool(fits.all())


def predict(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; only the text decides."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Rows) -> Rows:
        scorer = Scorer(sent.value)
        for ids, texts in id_text(batches):
            found = [scorer.predict(t) for t in texts]
            yield record(
                {
                    "doc_id": (ids, pa.int64()),
                    "held_out": ([held_out(i, folds) for i in ids], pa.bool_()),
                    "lang_pred": ([x for x, _ in found], pa.string()),
                    "score": ([x for _, x in found], pa.float64()),
                }
            )

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float | None = None, fitting: bool = False) -> DataFrame:
    """``documents`` whose language is recognised, with at least the score ``least`` if given; their columns are unchanged.

    ``fitting``: texts that are like none of the learnt languages go too; where nothing was learnt, all with a letter stay.
    """
    fitting = fitting and bool(model.languages)
    word_fits = model.fits(list(model.words)) if fitting else None
    lettered = not model.languages
    sent = docs.sparkSession.sparkContext.broadcast((model, word_fits))
    own = docs.select(*DOCUMENT_COLUMNS)
    at = DOCUMENT_COLUMNS.index("text")

    def keeps(scorer: Scorer, text: bytes | None) -> bool:
        if lettered:
            return any(map(str.isalpha, words_of(text)))
        lang, score, fits = scorer.fitting(text) if fitting else (*scorer.predict(text), True)
        return lang != UNKNOWN and fits and (least is None or score >= least)

    def run(batches: Rows) -> Rows:
        scorer = Scorer(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array([keeps(scorer, t.as_py()) for t in batch.column(at).cast(pa.binary())], pa.bool_()))

    return own.mapInArrow(run, own.schema)
