"""Quality rules: boosted trees over document statistics, flattened into arrays, monotonic in chosen features.

The trees are fitted on at most ``SAMPLE_ROWS`` labelled documents, those with the smallest hashes of their ids; every
document is scored. Null, empty and blank texts have no words and fail the base rule. Rows are independent, so ties and
repeated rows give repeated results; without labels the base rule alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Rows, id_text, map_text, picked, record
from tidemark.llm.statistics import BASE, FEATURES, measure

#: Bound on the labelled rows that the trees are fitted on.
SAMPLE_ROWS = 20_000
#: Features in which quality may only fall.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "bang_share", "bar_share", "longest_run_share")
MIN_WORDS = 50
KEEP_FROM = 0.5


@dataclass
class Trees:
    """Complete binary trees of one depth, node by node in level order."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[0] < inner if len(node) else False:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += value[node - inner]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, weight: float = 1.0, least: int = 20) -> Trees:
    """Logistic boosting over feature histograms.

    A split against a feature's sign is not considered, and a split's mean value bounds the values on either side of it
    below, so scores are monotonic in every signed feature.
    """
    inner, leaves = 2**depth - 1, 2**depth
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    rate_up = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(rate_up / (1 - rate_up)))
    margin = np.full(len(y), bias)
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best, choice = 1e-3, None
            if len(rows) >= 2 * least:
                g_all, h_all = grad[rows].sum(), hess[rows].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    size = len(c) + 1
                    g = np.cumsum(np.bincount(binned[rows, j], grad[rows], size))[:-1]
                    h = np.cumsum(np.bincount(binned[rows, j], hess[rows], size))[:-1]
                    m = np.cumsum(np.bincount(binned[rows, j], minlength=size))[:-1]
                    left = np.clip(g / (h + weight), low[k], high[k])
                    right = np.clip((g_all - g) / (h_all - h + weight), low[k], high[k])
                    gain = g * left + (g_all - g) * right - (h + weight) * left**2 / 2 - (h_all - h + weight) * right**2 / 2
                    bad = (m < least) | (len(rows) - m < least) | (signs[j] * (right - left) < 0)
                    gain = np.where(bad, -np.inf, gain) - g_all**2 / (h_all + weight) / 2
                    at = int(gain.argmax())
                    if gain[at] > best:
                        best, choice = gain[at], (j, at, left[at], right[at])
            low[2 * k + 1 : 2 * k + 3], high[2 * k + 1 : 2 * k + 3] = low[k], high[k]
            if choice is None:
                node[rows] = 2 * k + 1
                continue
            j, at, left, right = choice
            feature[k], threshold[k] = j, cuts[j][at]
            node[rows] = 2 * k + 1 + (binned[rows, j] > at)
            middle = (left + right) / 2
            if signs[j] > 0:
                high[2 * k + 1], low[2 * k + 2] = middle, middle
            elif signs[j] < 0:
                low[2 * k + 1], high[2 * k + 2] = middle, middle
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        value = rate * np.clip(g / (h + weight), low[inner:], high[inner:])
        value = np.where(np.isfinite(value), value, 0.0)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), bias)


def signs() -> np.ndarray:
    return np.array([-1 if name in FALLING else 0 for name in FEATURES])


def labelled_sample(labels: DataFrame, rows: int = SAMPLE_ROWS, label_col: str = "quality") -> DataFrame:
    """At most ``rows`` labelled ids, those with the smallest hashes; an id labelled twice counts by its lowest label."""
    named = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna()
    one = named.groupBy("_id").agg(F.min("_label").alias("_label"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from a bounded sample of labelled documents."""

    def run(batches: Rows) -> Rows:
        for batch in batches:
            at, labels_ = 0, batch.column(2).to_pylist()
            for ids, texts in id_text([batch]):
                found = [measure(t)[1] for t in texts]
                yield record({"features": (found, pa.list_(pa.float64())), "label": (labels_[at : at + len(ids)], pa.int32())})
                at += len(ids)

    # At most ``rows`` pairs of numbers: bounded, so it is sent to every task and the texts stay where they are.
    sample = F.broadcast(labelled_sample(labels, rows))
    joined = picked(docs, "doc_id", "text").join(sample, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_label")
    got = joined.mapInArrow(run, "features array<double>, label int").orderBy(F.xxhash64("features"), "features", "label").limit(2 * rows).collect()
    if len({r.label for r in got}) < 2:
        return Trees(np.empty((0, 0), np.int64), np.empty((0, 0)), np.empty((0, 1)), 20.0)
    return fit(np.array([r.features for r in got]), np.array([r.label for r in got], float), signs())


def score(docs: DataFrame, trees: Trees, min_words: int = MIN_WORDS, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, counts of ``BASE``, base_failed, kept, score) of every document."""

    def run(batches: Rows) -> Rows:
        for ids, texts in id_text(batches):
            found = [measure(t) for t in texts]
            base = np.array([b for b, _ in found], np.int64)
            chance = trees.probability(np.array([f for _, f in found]))
            failed = (base[:, 0] < min_words) | (100 * base[:, 4] > 50 * base[:, 0])
            columns = {"doc_id": (ids, pa.int64())} | {name: (base[:, k], pa.int64()) for k, name in enumerate(BASE)}
            columns |= {"base_failed": (failed, pa.bool_()), "kept": (~failed & (chance >= keep_from), pa.bool_()), "score": (chance, pa.float64())}
            yield record(columns)

    counts = ", ".join(f"{name} long" for name in BASE)
    return map_text(docs, run, f"doc_id long, {counts}, base_failed boolean, kept boolean, score double")
