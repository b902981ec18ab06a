"""Repeated windows against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import substrings


def plain(rows, window):
    """n_words, n_removed and digest of every row; rows with the same id and text are one document, different texts under
    one id follow by their hashes."""
    seen, out = {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)).view(np.int64)))
    for i, text in order:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[k : k + window]), (i, text, k)) != (i, text, k):
                gone[k : k + window] = [True] * window
        kept = [w for w, x in zip(words, gone) if not x]
        out[i, text] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus(seed, documents=60):
    draw = random.Random(seed)
    shared = [[draw.choice("abcdefghij") + str(draw.randrange(9)) for _ in range(draw.randrange(20, 60))] for _ in range(4)]
    rows = []
    for i in range(documents):
        words = []
        for _ in range(draw.randrange(1, 5)):
            if draw.random() < 0.6:
                words += draw.choice(shared)
            else:
                words += [draw.choice("xyz") * draw.randrange(1, 4) for _ in range(draw.randrange(1, 40))]
        rows.append((i * 3 % documents, draw.choice([" ", "\n", "\x0b"]).join(words)))
    rows += [(documents + 1, "rep " * 200), (documents + 2, rows[0][1]), (documents + 3, rows[0][1])]
    return rows


@pytest.mark.parametrize("window, width, seed", [(20, 5, 1), (20, 5, 2), (6, 3, 3)])
def test_digest(docs, monkeypatch, window, width, seed):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2_000)
    rows = [*corpus(seed), (None, "alone " * 30), (70, None), (71, ""), (72, "short text")]
    rows.append(rows[3])  # a repeated row does not repeat itself
    want = plain(rows, window)
    got = substrings.dedup_digest(docs(rows), window, width).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got))) == sorted(map(str, ((i, *want[i, t]) for i, t in rows)))
    assert any(r.n_removed for r in got)


def test_common_runs_do_not_change_the_result(docs, monkeypatch):
    """Every run common, some common, none common: the buckets differ, the windows do not."""
    rows = corpus(4)
    every = np.unique(np.concatenate([substrings.runs((t or "").encode().split(), 5) for _, t in rows]))
    results = []
    for common in (every, every[::3], every[:0]):
        monkeypatch.setattr(substrings, "_common_runs", lambda *_, found=common: found)
        results.append(sorted(map(str, substrings.dedup_digest(docs(rows)).collect())))
    assert results[0] == results[1] == results[2]


def test_common_runs_are_found(docs):
    rows = [(k, " ".join(["all", "rights", "are", "reserved", "here", *(f"w{k}-{n}" for n in range(40))])) for k in range(120)]
    common = substrings._common_runs(docs(rows), 20, 5, "doc_id", "text")
    assert common.tolist() == substrings.runs(b"all rights are reserved here".split(), 5).tolist()


def test_dedup_keeps_columns_and_changes_texts(docs, odd, empty):
    words = " ".join(f"w{k}" for k in range(50))
    rows = [(1, f"First\nline {words}"), (2, f"start {words} end"), (3, words), (4, "untouched\ntext"), (5, f" one\n\ntwo\t{words}\nthree\nfour"), (6, f"{words} \n x\n y "), (7, f"x\n y \n{words}")]
    got = {r.doc_id: r for r in substrings.dedup(docs(rows)).collect()}
    assert {i: r.text for i, r in got.items()} == {1: rows[0][1], 2: "start end", 4: "untouched\ntext", 5: " one\n\ntwo\tthree\nfour", 6: "x\n y ", 7: "x\n y"}
    assert got[2].n_chars == len("start end") and got[2].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    assert substrings.dedup(odd).count() == odd.count()
    assert substrings.dedup(empty).count() == 0 and substrings.dedup_digest(empty).count() == 0


def test_packed_strings_cover_every_window_once(docs):
    words = [w.encode() for w in corpus(9)[5][1].split()] * 3
    kmers, first, n = substrings.super_kmers(words, np.empty(0, np.uint64), 20, 5)
    covered = [k for a, b in zip(first.tolist(), n.tolist()) for k in range(a, a + b)]
    assert covered == list(range(len(words) - 19)) and len(kmers) == len(first)


def test_decisions_reach_no_other_row(docs):
    rows = corpus(11)
    found = substrings.repeated_windows(docs(rows)).groupBy("id").agg(F.count("*")).collect()
    want = plain(rows, 20)
    assert {r.id for r in found} == {i for (i, _), v in want.items() if v[1]}
