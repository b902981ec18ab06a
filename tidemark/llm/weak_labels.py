"""Weak-label quality: heuristics vote, expectation-maximisation finds how far each can be trusted, and the posterior
labels train a hashed linear scorer.

Votes of all documents are counted by pattern (at most ``3 ** len(VOTERS)``), and the estimation runs on these counts. The
linear scorer is fitted on at most ``SAMPLE_ROWS`` documents, those with the smallest hashes of their ids, with the
posterior of their pattern as target. Null and empty texts vote low and score low. Ties and repeated rows give repeated
results; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh32_intdigest

from tidemark.llm.common import Rows, id_text, map_text, picked, record
from tidemark.llm.statistics import FEATURES, measure

SAMPLE_ROWS = 8_000
DIMENSIONS = 1 << 16
KEEP_FROM = 0.5
MEMO_WORDS = 200_000
_AT = {name: k for k, name in enumerate(FEATURES)}


def _between(x: float, low: float, high: float) -> bool:
    return low <= x <= high


#: -1: low quality, 1: good, 0: no opinion. Each looks at its own figures, and several overlap.
VOTERS = (
    lambda f: -(f["symbol_share"] > 0.12),
    lambda f: -(f["bang_share"] > 0.3),
    lambda f: -(f["upper_share"] > 0.5),
    lambda f: -(f["bar_share"] > 0.2),
    lambda f: -(f["repeat_share"] > 0.5 and f["log_words"] > 3.5),
    lambda f: -(f["dup_line_share"] > 0.4 and f["log_words"] > 3.5),
    lambda f: -(f["longest_run_share"] > 0.12 and f["log_words"] > 2.5),
    lambda f: -(f["distinct_share"] < 0.25 and f["log_words"] > 4),
    lambda f: -(f["log_words"] == 0),
    lambda f: +(f["symbol_share"] < 0.02 and f["upper_share"] < 0.3 and f["bang_share"] < 0.1),
    lambda f: +((f["distinct_share"] > 0.35 or f["log_words"] < 4) and (f["longest_run_share"] < 0.1 or f["log_words"] < 2.5) and f["repeat_share"] < 0.4 and f["bar_share"] < 0.1),
    lambda f: +(_between(f["stop_share"], 0.01, 0.6) and f["bar_share"] < 0.1 and f["symbol_share"] < 0.1),
)


def votes(features: tuple[float, ...]) -> int:
    """All votes as one number in base three."""
    named = dict(zip(FEATURES, features))
    pattern = 0
    for voter in VOTERS:
        pattern = 3 * pattern + voter(named) + 1
    return pattern


def unfolded(patterns: np.ndarray, voters: int = len(VOTERS)) -> np.ndarray:
    """0, 1, 2 for low, no opinion, good: one row per pattern, one column per voter."""
    return np.stack([patterns // 3 ** (voters - 1 - k) % 3 for k in range(voters)], axis=1)


@dataclass
class LabelModel:
    prior: float
    chances: np.ndarray  # (class, voter, vote); having no opinion is a vote too

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """Probability of good quality for rows of votes."""
        logs = np.log(self.chances)
        each = [logs[c][np.arange(cast.shape[1]), cast].sum(axis=1) for c in (0, 1)]
        odds = np.log(self.prior) - np.log1p(-self.prior) + each[1] - each[0]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def estimate(cast: np.ndarray, counts: np.ndarray, steps: int = 100, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation over vote patterns; the first guess is that any low vote is right."""
    good = np.where((cast == 0).any(axis=1), 0.1, 0.9)
    model = LabelModel(0.5, np.ones((2, cast.shape[1], 3)) / 3)
    for _ in range(steps):
        weights = np.stack([(1 - good) * counts, good * counts])
        chances = np.stack([[np.bincount(cast[:, k], w, 3) + smooth for k in range(cast.shape[1])] for w in weights])
        model = LabelModel(float((weights[1].sum() + smooth) / (counts.sum() + 2 * smooth)), chances / chances.sum(axis=2, keepdims=True))
        now = model.posterior(cast)
        if np.abs(now - good).max(initial=0.0) < 1e-9:
            break
        good = now
    return model


_SHAPES = ((re.compile(rb"[A-Z]+"), b"X"), (re.compile(rb"[a-z\x80-\xff]+"), b"x"), (re.compile(rb"[0-9]+"), b"9"))


def _shape(word: bytes) -> bytes:
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return word[:12]


class Hasher:
    """Normalised counts of hashed words and word shapes, kept per distinct word up to a bound, and hashed steps of the figures."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.known = dimensions, {}

    def _columns(self, word: bytes) -> tuple[int, int]:
        if len(self.known) >= MEMO_WORDS:
            self.known.clear()
        half = self.dimensions // 2
        got = self.known[word] = (xxh32_intdigest(word.lower()) % half, half + xxh32_intdigest(_shape(word)) % half)
        return got

    def columns(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        known = self.known
        return np.array([known.get(w) or self._columns(w) for w in words], np.int64).reshape(-1)

    def sparse(self, text: bytes | None, features: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.unique(self.columns(text), return_counts=True)
        steps = [xxh32_intdigest(f"{name} {min(int(10 * x), 60)}") % self.dimensions for name, x in zip(FEATURES, features)]
        scaled = n / max(1.0, np.sqrt((n**2).sum()))
        return np.concatenate([at, np.array(steps, np.int64)]), np.concatenate([scaled, np.full(len(steps), 0.5)])


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def score(self, at: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ values + self.bias, -50, 50))))


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, dimensions: int = DIMENSIONS, epochs: int = 8, rate: float = 0.8, decay: float = 1e-5, seed: int = 7) -> Linear:
    """Logistic regression on soft labels by adaptive gradient steps; classes weigh alike."""
    weights, squares, bias = np.zeros(dimensions), np.full(dimensions, 1e-2), 0.0
    share = float(np.clip(targets.mean(), 0.02, 0.8)) if len(targets) else 0.5
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            t = targets[k]
            p = 1 / (1 + np.exp(-np.clip(weights[at] @ x + bias, -50, 50)))
            step = (t * (1 - p) / share - (1 - t) * p / (1 - share)) / 2
            g = step * x - decay * weights[at]
            squares[at] += g * g
            weights[at] += rate * 0.2 * g / np.sqrt(squares[at])
            bias += 0.02 * step
    return Linear(weights, float(bias))


def label_model(docs: DataFrame) -> LabelModel:
    """Accuracies of the voters, from the votes of every document."""

    def run(batches: Rows) -> Rows:
        for ids, texts in id_text(batches):
            patterns, n = np.unique([votes(measure(t)[1]) for t in texts], return_counts=True)
            yield record({"pattern": (patterns, pa.int64()), "n": (n, pa.int64())})

    counted = map_text(docs, run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counted = sorted(counted)
    return estimate(unfolded(np.array([r[0] for r in counted], np.int64)), np.array([r[1] for r in counted], float))


def train(docs: DataFrame, model: LabelModel, rows: int = SAMPLE_ROWS) -> Linear:
    """The scorer, from a bounded sample of all documents with their posterior labels."""

    def run(batches: Rows) -> Rows:
        hasher = Hasher()
        for ids, texts in id_text(batches):
            figures = [measure(t)[1] for t in texts]
            found = [hasher.sparse(t, f) for t, f in zip(texts, figures)]
            good = model.posterior(unfolded(np.array([votes(f) for f in figures], np.int64)))
            yield record(
                {
                    "doc_id": (ids, pa.int64()),
                    "at": ([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                    "x": ([x.astype(np.float32) for _, x in found], pa.list_(pa.float32())),
                    "good": (good, pa.float64()),
                }
            )

    own = picked(docs, "doc_id", "text")
    chosen = F.broadcast(own.select(F.col("doc_id").alias("_id")).dropna().distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows))
    sample = own.join(chosen, F.col("doc_id") == F.col("_id"), "left_semi").mapInArrow(run, "doc_id long, at array<int>, x array<float>, good double")
    got = sample.orderBy("doc_id", "good").limit(2 * rows).toArrow()
    lists = zip(got["at"].to_pylist(), got["x"].to_pylist())
    return fit_linear([(np.array(a, np.int64), np.array(x)) for a, x in lists], got["good"].to_numpy())


def score(docs: DataFrame, model: LabelModel, scorer: Linear, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, posterior, score, kept) of every document; ``kept`` follows the scorer."""

    def run(batches: Rows) -> Rows:
        hasher = Hasher()
        for ids, texts in id_text(batches):
            figures = [measure(t)[1] for t in texts]
            good = model.posterior(unfolded(np.array([votes(f) for f in figures], np.int64)))
            found = np.array([scorer.score(*hasher.sparse(t, f)) for t, f in zip(texts, figures)])
            yield record(
                {
                    "doc_id": (ids, pa.int64()),
                    "posterior": (good, pa.float64()),
                    "score": (found, pa.float64()),
                    "kept": (found >= keep_from, pa.bool_()),
                }
            )

    return map_text(docs, run, "doc_id long, posterior double, score double, kept boolean")
