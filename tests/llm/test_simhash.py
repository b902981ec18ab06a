"""Fingerprints, links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import connected_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, diff=2):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= diff and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("text", ["", None, "A", "A b", "a B c", "a a a a a a", "É x\x0by\x1cz " * 40])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_links_connect_as_all_pairs_would(spark, limit):
    draw = random.Random(5)
    values = set()
    for _ in range(40):
        one = draw.getrandbits(64)
        values.add(one)
        for _ in range(draw.randrange(6)):
            one ^= 1 << draw.randrange(64)
            one ^= 1 << draw.randrange(64)
            values.add(one)
    base = draw.getrandbits(64)  # a crowd on one key: neighbours of one value
    values |= {base ^ (1 << k) for k in range(30)} | {base ^ (1 << k) ^ (1 << (k + 1)) for k in range(0, 20, 2)}
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = simhash.pigeonring_links(prints, pair_limit=limit)
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in pairs)
    got = {r.node: r.root for r in connected_components(links).collect()}
    want = {}
    for v, r in roots(sorted(values)).items():
        want.setdefault(r, []).append(signed(v))
    assert {frozenset(m) for m in want.values() if len(m) > 1} == {frozenset(n for n, r in got.items() if r == root) for root in set(got.values())}
    assert all(root == min(n for n, r in got.items() if r == root) for root in set(got.values()))


def test_components_of_a_path_and_of_nothing(spark):
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected_components(path).collect()} == {0}
    assert connected_components(path.filter("a < 0")).count() == 0


def test_near_duplicates(docs, odd, empty):
    words = [f"w{k}" for k in range(400)]
    near = list(words)
    near[200] = "changed"
    rows = [(30, " ".join(words)), (20, " ".join(words).upper()), (25, " ".join(near)), (40, "something else entirely here"), (None, " ".join(words)), (30, " ".join(words))]
    both = docs(rows).unionByName(odd)
    got = both.select("doc_id", "text").collect()
    prints = {plain_fingerprint(r.text) for r in got}
    root = roots(sorted(prints))
    least = {}
    for r in got:
        if r.doc_id is not None:
            key = root[plain_fingerprint(r.text)]
            least[key] = min(least.get(key, r.doc_id), r.doc_id)
    want = sorted(str((r.doc_id, plain_fingerprint(r.text), least.get(root[plain_fingerprint(r.text)]))) for r in got)
    found = simhash.near_duplicates(both).collect()
    assert sorted(str((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in found) == want
    kept = simhash.representatives(both).collect()
    assert len(kept) == len(set(root.values()))
    assert {plain_fingerprint(r.text) for r in kept} <= prints and {root[plain_fingerprint(r.text)] for r in kept} == set(root.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0


def test_representatives_of_groups_that_share_an_id(docs):
    """Ids drawn from few, so that unlinked groups have the same smallest id: every group keeps one text of its own."""
    draw = random.Random(9)
    texts = [" ".join(f"g{g}w{k}" for k in range(30)) for g in range(12)] + [""]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1])]
    rows += [(draw.choice([None, 1, 2, 3, 4]), draw.choice(texts)) for _ in range(80)]
    prints = {t: plain_fingerprint(t) for t in texts}
    root = roots(sorted(set(prints.values())))
    kept = [(r.doc_id, r.text) for r in simhash.representatives(docs(rows)).collect()]
    for group in set(root.values()):
        inside = [(i, t) for i, t in rows if root[prints[t]] == group]
        ids = [i for i, _ in inside if i is not None]
        own = [(i, t) for i, t in kept if root[prints[t]] == group]
        if inside and ids:
            assert len(own) == 1 and own[0] in inside and own[0][0] == min(ids)
        else:
            assert sorted(own, key=str) == sorted(set(inside), key=str)


def test_numbers_of_bits_other_than_two_are_refused(spark):
    with pytest.raises(ValueError, match="two bits"):
        simhash.pigeonring_links(spark.createDataFrame([(1,)], "fp long"), max_diff=3)


def test_fingerprint_of_long_text_counts_every_shingle():
    rng = np.random.default_rng(1)
    text = " ".join(f"w{k}" for k in rng.integers(0, 5000, 70_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
