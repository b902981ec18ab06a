"""Phrase collocations against a plain count, with and without colliding fingerprints."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import collocations


def plain(rows, min_count, inside, top, max_words=3):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in candidates.items():
            longer = (b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * b >= inside * a for b in longer):
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    words = ["a", "A", "b", "é", "ß", "日本", "longerword", "x-y", "0", "\x1c", "the"]
    gaps = [" "] * 12 + ["  ", "\t", " \t ", ".", ", ", "\n", "\r\n", "!? ", "\x0b"]
    texts = ["".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randrange(400))) for _ in range(60)]
    return [(i, t, draw.choice(["en", "de", None])) for i, t in enumerate(texts)]


@pytest.mark.parametrize("mask", [(1 << 64) - 1, 0x3F, 0])
def test_counts_and_scores(docs, odd, corpus, monkeypatch, mask):
    both = docs(corpus + corpus[:5]).unionByName(odd)
    rows = [(r.text, r.lang) for r in both.select("text", "lang").collect()]
    if mask != (1 << 64) - 1:
        counted = collocations.phrase_counts
        monkeypatch.setattr(collocations, "phrase_counts", lambda d, w, m: counted(d, w, m, mask))
    got = collocations.collocations(both, min_count=4, top=25).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = plain(rows, 4, 50, 25)
    assert len(want) > 40
    assert sorted(tuple(r) for r in got) == want


def test_longer_phrases_and_no_bound(docs, corpus):
    got = collocations.collocations(docs(corpus), max_words=5, min_count=3, inside=80, top=None).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(tuple(r) for r in got) == plain([(t, g) for _, t, g in corpus], 3, 80, None, max_words=5)


def test_equal_texts(docs):
    text = "alpha beta gamma " * 30
    rows = [(i, text, "en") for i in range(40)]
    got = {r.phrase: r.n for r in collocations.phrase_counts(docs(rows)).collect()}
    assert got["alpha beta gamma"] == 40 * 30 and got["gamma alpha"] == 40 * 29 and got[""] == 40 * 90


def test_bytes_exchanged_per_run(docs):
    draw = random.Random(5)
    texts = [[f"w{int(draw.paretovariate(0.4)) % 30_000}" for _ in range(300)] for _ in range(300)]
    runs = {tuple(t[i : i + k]) for t in texts for k in (1, 2, 3) for i in range(len(t) - k + 1)}
    entries = collocations._entries(docs([(i, " ".join(t)) for i, t in enumerate(texts)]), 3, collocations.KEPT_BITS, 3)
    back = collocations._frequent(entries, 3, 10, 3)
    sent = sum(len(r.packed) for df in (entries, back) for r in df.select("packed").collect() if r.packed[:1] != b"T")
    assert 1 < sent / len(runs) < 5


def test_same_bytes_in_other_texts(docs):
    rows = [(1, "x x\ny", "en"), (2, "z", "de"), (3, "x x", "en"), (4, "y\nz", "de")]
    both = docs(rows).repartitionByRange(2, "doc_id").sortWithinPartitions("doc_id")  # two blocks of the same bytes
    assert [[r.doc_id for r in part] for part in both.rdd.glom().collect()] == [[1, 2], [3, 4]]
    got = {(r.lang, r.phrase): r.n for r in collocations.phrase_counts(both, 2, 1).collect()}
    assert got == {("en", ""): 5, ("de", ""): 3, ("en", "x"): 4, ("en", "x x"): 2, ("en", "y"): 1, ("de", "y"): 1, ("de", "z"): 2}


def test_any_name_of_a_language(docs):
    rows = [(i, "a b", g) for i, g in enumerate(["x", "x\0y", "", "y"])]
    got = {(r.lang, r.phrase): r.n for r in collocations.phrase_counts(docs(rows), 2, 1).collect()}
    assert got == {(g, p): n for _, _, g in rows for p, n in (("", 2), ("a", 1), ("b", 1), ("a b", 1))}


def test_packs_name_their_own_languages_only():
    block, counter = collocations.Block(), collocations.Counter(2, collocations.KEPT_BITS)
    for i in range(500):
        block.add(b"one two " * 3, f"language-{i:05}".encode())
    rows = block.emit(counter, 50).to_pylist()
    text, kept = next(r["packed"] for r in rows if r["packed"][:1] == b"T"), []
    for r in rows:
        if r["packed"][:1] == b"E":
            counts = collocations.unpack(r["packed"][1:])[1::2]
            kept.append(b"K" + collocations.pack(np.array([r["part"]]), *(np.packbits(np.ones(len(c) // 4, bool)) for c in counts)))
    packs = [collocations.unpack(b.column("packed")[0].as_py()) for b in collocations._phrases(text, 1, kept, counter, 50)]
    assert sum(len(p[0]) for p in packs) == 500 * 5 and all(len(p) - 5 <= len(p[0]) for p in packs)


def test_keys_in_order():
    draw = np.random.default_rng(2)
    for low in (0, 5):
        keys = draw.integers(0, 50, 1000).astype(np.uint64) << np.uint64(40) | np.uint64(low)
        got, at = collocations.ordered(keys)
        order = np.argsort(keys, kind="stable")
        assert (got == keys[order]).all() and (at == order).all()


def test_nothing_to_count(docs, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs([(1, None), (2, " .,\n"), (3, "once only")])).count() == 0


def test_products_beyond_64_bits(spark, docs, monkeypatch):
    big = 5_000_000_000
    rows = [("en", 0, "", 9 * big), ("en", 1, "a", 3 * big), ("en", 1, "b", 2 * big), ("en", 2, "a b", big)]
    counted = spark.createDataFrame(rows, "lang string, words int, phrase string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: counted)
    (row,) = collocations.collocations(docs([])).collect()
    assert (row.a, row.l, row.r, row.n, row.score) == (big, 3 * big, 2 * big, 9 * big, 10**6 * big * big // (6 * big * big))


def test_word_spans_and_hashes():
    text = b"ab  a\tab.b\xc3\xa9 ab\n\nb"
    data = np.frombuffer(text, np.uint8)
    words = collocations.Words.of(data)
    found = [text[s:e] for s, e in zip(words.start, words.end)]
    assert found == [b"ab", b"a", b"ab", b"b\xc3\xa9", b"ab", b"b"] and words.piece.tolist() == [0, 0, 0, 1, 1, 3]
    hashes = collocations.word_hashes(data, words, collocations.Powers(collocations._BYTE_BASE))
    assert len(set(hashes.tolist())) == 4 and hashes[0] == hashes[2] == hashes[4]
    ids = collocations.word_ids(data, words, np.zeros(6, np.uint64))
    assert ids[0] == ids[2] == ids[4] and len(set(ids.tolist())) == 4
