"""Language identification: held-out accuracy, fallback, odd rows."""

import base64
import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language.predict(docs, language.train(docs)).collect()}
    rows = docs.collect()
    held = [r for r in rows if got[r.doc_id].held_out and (r.text or "").strip()]
    assert len(held) > 100 and np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.98
    assert {r.doc_id for r in rows if got[r.doc_id].held_out} == {r.doc_id for r in rows if language.held_out(r.doc_id)}


def test_only_learning_rows_count(docs):
    rows = [(k, "alpha beta" if language.held_out(k) else "gamma gamma", "aa") for k in range(40)] + [(50, "delta", None)]
    found = {(r.size, r.gram): r.n for r in language.counts(docs(rows)).collect()}
    learnt = sum(not language.held_out(k) for k in range(40))
    assert found[0, "gamma"] == 2 * learnt and (0, "alpha") not in found and (0, "delta") not in found
    assert found[3, "<ga"] == found[4, "mma>"] == 2 * learnt and found[1, "m"] == 4 * learnt


def test_bounds_keep_the_most_frequent(docs):
    rows = [(k, "often often often " + f"rare{chr(97 + k)}", "aa") for k in range(20)]
    model = language.train(docs(rows), words=1, learns=lambda i: True)
    assert list(model.words) == ["often"]


def test_words_come_first_and_unseen_ones_fall_back():
    model = language.Model.of(["a", "b"], {"see": np.array([-1.0, -9.0], np.float32)}, [{"z": np.array([-1.0, -2.0], np.float32)}, {"q>": np.array([-5.0, -1.0], np.float32)}, {}, {}])
    scorer = language.Scorer(model)
    assert scorer.predict(b"See")[0] == "a"  # a known word, its n-grams unread
    assert scorer.predict(b"zq")[0] == "b"  # two characters before one
    assert scorer.predict(b"zy")[0] == "a"
    assert scorer.predict("½ 12 _".encode()) == ("und", 0.0)


def test_forgotten_words_are_still_added(monkeypatch):
    monkeypatch.setattr(language, "MEMO_WORDS", 3)
    grams = [{c: np.array([-1.0, -3.0], np.float32) for c in "abcdefgh"}, {}, {}, {}]
    small = language.Scorer(language.Model.of(["a", "b"], {}, grams))
    assert small.predict(b"a b c d e f g h " * 3)[0] == "a"


def test_odd_rows(odd, empty, docs):
    model = language.train(docs([(k, "the same words here", "en") for k in range(10)] + [(k, "andere worte dort", "de") for k in range(10, 20)]))
    got = language.predict(odd, model).collect()
    assert len(got) == odd.count()
    assert sum(r.lang_pred == "und" for r in got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert language.predict(empty, model).count() == 0
    nothing = language.train(empty)
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    kept = language.identified(odd, model, 0.4)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == odd.count() - 3


def test_texts_in_no_learnt_language_go(spark, docs, odd):
    clean = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(7)
    mash = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(n)) for n in (2, 5, 40)]
    blob = base64.b64encode(rng.bytes(600)).decode()
    bad = [(-k, t, None) for k, t in enumerate([*mash, blob, "съешь же ещё этих мягких булок", "今天天气怎么样", "γειά σου κόσμε"], 1)]
    words = [w for (t,) in clean.filter("text is not null").select("text").limit(200).collect() for w in language.words_of(t.encode())[:3]]
    short = [(10_000 + k, " ".join(words[k : k + 2]), None) for k in range(0, 400, 2)]
    every = docs([*map(tuple, clean.collect()), *short, *bad])
    stage = corpus_pipeline.language_id(spark, every, "")
    kept = {r.doc_id for r in stage.select("doc_id").collect()}
    lettered = {r.doc_id for r in clean.collect() if any(map(str.isalpha, r.text or ""))}
    assert not kept & {i for i, _, _ in bad}
    assert lettered <= kept and len(kept - lettered) == len(short)
    # Nothing to learn from: letters decide.
    assert corpus_pipeline.language_id(spark, odd.withColumn("lang", F.lit(None).cast("string")), "").count() == odd.count() - 3


def plain_model(rows, most_words, most_grams):
    """Counts by size, gram and language, cut to what one of the languages keeps; totals and numbers of entries before the cut."""
    counted = collections.Counter()
    for text, lang in rows:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            counted[0, word, lang] += 1
            for n in range(1, language.LONGEST + 1):
                padded = f"<{word}>" if n > 1 else word
                counted.update((n, padded[k : k + n], lang) for k in range(len(padded) - n + 1))
    langs, kept, every = sorted({lang for _, lang in rows}), set(), {}
    for size in range(language.LONGEST + 1):
        for lang in langs:
            own = {g: n for (s, g, x), n in counted.items() if (s, x) == (size, lang)}
            every[size, lang] = math.log(sum(own.values()) + language.SMOOTH * (len(own) + 1))
            floors = [f for f in set(own.values()) if sum(n >= f for n in own.values()) <= (most_grams if size else most_words)]
            kept |= {(size, g) for g, n in own.items() if floors and n >= min(floors)}
    return {(s, g): [math.log(counted[s, g, x] + language.SMOOTH) - every[s, x] for x in langs] for s, g in kept}


def plain_language(model, langs, text):
    total = [0.0] * len(langs)
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        rows = [model[0, word]] if (0, word) in model else []
        for n in range(language.LONGEST, 0, -1):
            padded = f"<{word}>" if n > 1 else word
            rows = rows or [model[n, padded[k : k + n]] for k in range(len(padded) - n + 1) if (n, padded[k : k + n]) in model]
        for k in range(len(langs)):
            total[k] += sum(r[k] for r in rows) / max(1, len(rows))
    return total


@pytest.mark.parametrize("most_words, most_grams", [(30_000, 40_000), (40, 60)])
def test_model_and_predictions_equal_a_plain_version(spark, most_words, most_grams):
    table = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in table.collect() if r.text is not None]
    plain = plain_model([(r.text, r.lang) for r in rows if r.lang is not None], most_words, most_grams)
    model = language.train(table, words=most_words, n_grams=most_grams, learns=lambda i: True)
    assert model.languages == sorted({r.lang for r in rows if r.lang is not None})
    got = {(0, w): model.word_rows[k] for w, k in model.words.items()}
    got |= {(n + 1, g): model.gram_rows[n][k] for n, named in enumerate(model.grams) for g, k in named.items()}
    assert got.keys() == plain.keys()
    assert all(np.allclose(got[key], plain[key], atol=1e-4) for key in plain)
    found = {r.doc_id: r.lang_pred for r in language.predict(table, model).collect()}
    clear = 0
    for r in rows:
        total = plain_language(plain, model.languages, r.text)
        first, second = sorted(total, reverse=True)[:2]
        if first - second > 0.01:
            clear += 1
            assert found[r.doc_id] == model.languages[int(np.argmax(total))]
    assert clear > 50


def test_kept_entries_count_in_every_language(docs):
    """A word that one language keeps has its counts in the others too, however high their own floors are."""
    rows = [(1, "shared " * 3 + "often " * 9 + "more " * 8, "aa"), (2, "shared " * 5, "bb")]
    model = language.train(docs(rows), words=1, learns=lambda i: True)
    assert set(model.words) == {"often", "shared"}
    row = model.word_rows[model.words["shared"]]
    assert np.allclose(row, [math.log(3.5) - math.log(20 + 0.5 * 4), math.log(5.5) - math.log(5 + 0.5 * 2)], atol=1e-5)
