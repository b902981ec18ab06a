"""Document figures, boosted trees, weak labels."""

import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import quality_rules, weak_labels
from tidemark.llm.statistics import BASE, FEATURES, measure

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é|#\n\t\x0b\x85A!"), max_size=120))
def test_counts(text):
    assert measure(text.encode())[0] == plain_counts(text)


def test_counts_of_nothing_and_of_many_words():
    assert measure(None) == ((0, 0, 0, 0, 0), (0.0,) * len(FEATURES))
    text = " ".join(str(k % 40_000) for k in range(90_000))
    assert measure(text.encode())[0] == plain_counts(text)


def test_scores_are_monotonic():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(FEATURES)))
    y = ((x[:, 2] + 0.3 * np.sin(9 * x[:, 2]) + x[:, 1] + 0.2 * rng.standard_normal(3000)) < 1).astype(float)
    trees = quality_rules.fit(x, y, quality_rules.signs(), rounds=20)
    at = FEATURES.index("symbol_share")
    assert "symbol_share" in quality_rules.FALLING
    for row in x[:40]:
        line = np.repeat(row[None], 200, axis=0)
        line[:, at] = np.linspace(-0.2, 1.2, 200)
        assert (np.diff(trees.probability(line)) <= 1e-12).all()
    assert ((trees.probability(x) > 0.5) == (y > 0.5)).mean() > 0.85


def test_flattened_trees_follow_their_nodes():
    trees = quality_rules.Trees(np.array([[0, 1, 1]]), np.array([[0.5, 0.2, 0.8]]), np.array([[-4.0, -2.0, 2.0, 4.0]]), 0.0)
    x = np.array([[0.5, 0.2], [0.5, 0.3], [0.6, 0.8], [0.6, 0.9]])
    assert np.allclose(np.log(trees.probability(x) / (1 - trees.probability(x))), [-4, -2, 2, 4])


def test_rules_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_rules.score(docs, quality_rules.train(docs, labels)).collect()}
    for r in docs.collect():
        assert tuple(got[r.doc_id][c] for c in BASE) == plain_counts(r.text)
        failed = got[r.doc_id].n_words < 50 or 100 * got[r.doc_id].n_repeat_words > 50 * got[r.doc_id].n_words
        assert got[r.doc_id].base_failed == failed and not (failed and got[r.doc_id].kept)
    judged = [(r.quality, got[r.doc_id].kept) for r in labels.collect() if not got[r.doc_id].base_failed]
    assert np.mean([q == k for q, k in judged]) > 0.97


def test_rules_without_labels_and_without_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.score(odd, quality_rules.train(odd, none)).collect()
    assert len(got) == odd.count() and all(r.kept == (not r.base_failed) for r in got)
    twice = spark.createDataFrame([(5, 0), (5, 1), (6, None), (None, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in quality_rules.labelled_sample(twice).collect()] == [(5, 0)]
    assert quality_rules.score(empty, quality_rules.train(empty, none)).count() == 0


def test_estimation_finds_the_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(40_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    silent = rng.random((len(truth), 5)) < 0.2
    votes = np.where(rng.random((len(truth), 5)) < right, truth[:, None], ~truth[:, None]) * 2
    patterns, n = np.unique(np.where(silent, 1, votes) @ 3 ** np.arange(4, -1, -1), return_counts=True)
    model = weak_labels.estimate(weak_labels.unfolded(patterns, 5), n.astype(float))
    assert abs(model.prior - 0.8) < 0.05
    found = model.chances[1, :, 2] / (1 - model.chances[1, :, 1])
    assert np.abs(found - right).max() < 0.06


def test_weak_labels_agree_with_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = weak_labels.label_model(docs)
    got = {r.doc_id: r for r in weak_labels.score(docs, model, weak_labels.train(docs, model)).collect()}
    assert len(got) == docs.count()
    pairs = [(r.quality, got[r.doc_id].kept, got[r.doc_id].posterior >= 0.5) for r in labels.collect()]
    for of in (1, 2):
        assert np.mean([p[of] for p in pairs if p[0] == 1]) > 0.97
        assert np.mean([not p[of] for p in pairs if p[0] == 0]) > 0.93


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_weak_labels_on_odd_rows(request, which):
    docs = request.getfixturevalue(which)
    model = weak_labels.label_model(docs)
    got = weak_labels.score(docs, model, weak_labels.train(docs, model)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
