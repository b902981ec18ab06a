"""Scores against brute force: exact bases, distributions that add up, held-out gain."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import pitman_yor
from tidemark.llm.common import unpack


def plain_base(rows):
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    count = collections.Counter(w for (i, _), ws in zip(rows, tokens) if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for (i, _), ws in zip(rows, tokens)]


def chain(seed, documents=120):
    """Words that mostly follow from the one before."""
    draw = random.Random(seed)
    rows = []
    for i in range(documents):
        word, words = 0, []
        for _ in range(draw.randrange(5, 80)):
            word = (word * 3 + 1) % 50 if draw.random() < 0.8 else draw.randrange(200)
            words.append(f"W{word}")
        rows.append((i, " ".join(words)))
    return rows


def rounded(rows):
    return sorted(str((i, a, b, c, round(d, 6))) for i, a, b, c, d in rows)


@pytest.mark.parametrize("load", [0.05, 1e-4])
def test_bases_and_gain(docs, monkeypatch, load):
    monkeypatch.setattr(pitman_yor, "FREQUENT_LOAD", load)
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 500)
    rows = [*chain(1), (None, "W1 W4"), (300, None), (301, ""), (302, "unseen words only"), (5, "W1 W4 W13"), (5, "W1 W4 W13")]
    table = docs(rows)
    got = pitman_yor.score(table, *pitman_yor.train(table)).collect()
    assert rounded((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == rounded(plain_base(rows))
    held = [r for r in got if r.held_out and r.n_tokens > 10]
    assert len(held) > 5 and all(r.score > r.base_score for r in held)
    assert all(np.isfinite(r.score) and r.score <= 1e-9 for r in got)


@pytest.mark.parametrize("frequent", [False, True])
def test_chances_add_up(docs, monkeypatch, frequent):
    """Over all known words and one unseen word the probabilities of a context make one."""
    if not frequent:
        monkeypatch.setattr(pitman_yor, "_frequent_words", lambda docs: np.empty(0, np.uint64))
    model, shared = pitman_yor.train(docs(chain(2, 200)), wanted=lambda i: True)
    if frequent:
        assert len(shared.frequent)
    total = np.zeros(pitman_yor.CONTEXTS)
    words = set()
    for row in model.collect():
        bucket = pitman_yor.Bucket(*unpack(bytes(row.block)[1:]))
        own, chance, _, _ = bucket.sweep(shared, np.random.default_rng(row.part))
        np.add.at(total, bucket.ctx, own / (pitman_yor.STRENGTH + shared.customers[bucket.ctx]))
        back = (pitman_yor.STRENGTH + shared.discount * shared.tables) / (pitman_yor.STRENGTH + shared.customers)
        fresh = [k for k, w in enumerate(bucket.words.tolist()) if w not in words]
        words.update(bucket.words.tolist())
        total += back * chance[fresh].sum()
    total += back * shared.word_chance(np.zeros(1), np.zeros(1))[0]
    used = shared.customers > 0
    # Tables are sampled anew by the last sweeps, so the shared figures differ from theirs by noise.
    assert np.average(total[used], weights=shared.customers[used]) == pytest.approx(1, abs=0.05)


def test_seating_follows_the_expected_number_of_tables():
    rng = np.random.default_rng(1)
    for customers, mass, discount in ((10, 0.5, 0.3), (2000, 1.5, 0.5)):
        tables, expected = pitman_yor.seat(np.full(4000, customers), np.full(4000, mass), discount, rng), 1.0
        for k in range(1, customers):
            expected += mass / (mass + k - discount * expected)
        assert tables.mean() == pytest.approx(expected, rel=0.05)
        assert tables.min() >= 1 and tables.max() <= customers
    assert (pitman_yor.seat(np.ones(5, np.int64), np.ones(5), 0.5, rng) == 1).all()


def test_odd_rows(odd, empty):
    got = pitman_yor.score(odd, *pitman_yor.train(odd)).collect()
    assert len(got) == odd.count() and all(np.isfinite(r.score) for r in got)
    assert pitman_yor.score(empty, *pitman_yor.train(empty)).count() == 0
    unlearnt = pitman_yor.score(odd, *pitman_yor.train(empty)).collect()
    assert {(r.n_known, r.train_tokens, round(r.base_score, 9)) for r in unlearnt} == {(0, 0, 0.0)}
    assert all(r.score == pytest.approx(0) for r in unlearnt)
