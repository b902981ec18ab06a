"""Similarity classes against all pairs, and what the pruning promises."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import jaccard_join as jj


def plain_set(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, percent=85):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(str((i, len(sets[k]), least.get(find(k)))) for k, (i, _) in enumerate(rows))


def found(frame, **options):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in jj.classes(frame, **options).collect())


def edited(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        out[draw.randrange(len(out))] = f"e{draw.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("slice_size", [3, 2000])
def test_classes(docs, odd, slice_size):
    draw = random.Random(slice_size)
    rows = []
    for group in range(25):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([1, 3, 4, 9, 11, 14, 20, 45, 120, 400]))]
        for _ in range(draw.choice([1, 2, 3, 5])):
            rows.append((len(rows) * 3 % 101, edited(draw, words, draw.randrange(1 + len(words) // 30))))
    # crowds: copies around a base, copies without one (near the threshold), one passage in many texts
    base = [f"c{k}" for k in range(160)]
    rows += [(200 + k, edited(draw, base, 2)) for k in range(30)] + [(150, " ".join(base))]
    other = [f"d{k}" for k in range(100)]
    rows += [(300 + k, edited(draw, other, 2)) for k in range(30)]
    rows += [(400 + k, " ".join(other[:40]) + " " + " ".join(f"p{draw.randrange(10**6)}" for _ in range(3))) for k in range(30)]
    rows += [(500, "Short TEXT"), (501, "short text"), (502, "a b c"), (503, "a b c d")]
    both = docs(rows).unionByName(odd)
    every = [(r.doc_id, r.text) for r in both.select("doc_id", "text").collect()]
    assert found(both, slice_size=slice_size) == brute(every)


def test_no_rows_and_no_words(docs, empty):
    assert jj.classes(empty).count() == 0
    assert found(docs([(1, None), (2, ""), (3, " \n"), (None, None)])) == brute([(1, None), (2, ""), (3, " \n"), (None, None)])


def test_linking_sets_share_a_tile_and_stay_below_the_bound():
    draw = np.random.default_rng(1)
    met = 0
    for _ in range(3000):
        size = int(draw.choice([6, 7, 8, 9, 12, 13, 14, 20, 40, 100, 300]))
        pool = np.unique(draw.integers(0, 1 << 64, size * 2, dtype=np.uint64))
        draw.shuffle(pool)
        a = np.sort(pool[:size])
        lose, gain = int(draw.integers(0, 2 + size // 8)), int(draw.integers(0, 2 + size // 8))
        b = np.sort(np.concatenate([a[np.sort(draw.permutation(size)[lose:])], pool[size : size + gain]]))
        both = len(np.intersect1d(a, b))
        words = min(len(jj.bitmap(a)), len(jj.bitmap(b)))
        bound = jj.overlap_bound(jj.folded(jj.bitmap(a), words), len(a), jj.folded(jj.bitmap(b), words)[None], np.array([len(b)]))
        assert bound[0] >= both
        if lose + gain and jj.links(len(a), len(b), both, 85):
            met += 1
            assert np.intersect1d(jj.tile_keys(a, 85), jj.tile_keys(b, 85)).size
    assert met > 500


def test_crowds_stay_out_of_the_buckets(docs):
    """Sets of one content are dealt as crowd rows by the task that finds them often; each bucket gets one of them, marked."""
    rows = [(k, " ".join(f"s{j}" for j in range(60)) + f" own{k}") for k in range(200)]
    tiles = jj.tiles(docs(rows))
    kinds = {r.kind: r["count"] for r in tiles.groupBy("kind").count().collect()}
    assert kinds[jj.CROWD] > 0 and kinds.get(jj.PAIR, 0) < 2000 and kinds[jj.DOC] == 200
    assert {r.component_id for r in jj.classes(docs(rows)).collect()} == {0}
