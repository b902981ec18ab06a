"""Template matches: verbatim, re-parameterised, inconsistent, clean."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination

SF = "/root/testdata/sf0.01"
ITEM = "A train with Maria leaves the northern station at 9 and travels 120 km in 3 hours before Maria changes to a slower line for 40 minutes"


@pytest.fixture
def benchmark(spark):
    rows = [(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "too few words"), (5, "seven plain words make one small item"), (6, "12 13 14 15 16 17 18 19 20 21 22"), (None, "an item that has no number of its own but many plain words")]
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "item_id long, text string, key int, slots string")


def found(docs, benchmark):
    return {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark).collect()}


def test_cases(docs, benchmark):
    other = ITEM.replace("Maria", "Peter").replace("120 km", "95 miles").replace("9 and", "seven and").replace("3 hours", "2 hours").replace("40", "15")
    clash = "A train with Peter leaves the northern station at 7 and travels 95 miles in 2 days before Olga changes to a slower line for 15 weeks"
    rows = [
        (1, f"Some text before. {ITEM} and after."),
        (2, f"Some text before.\n{other}. And after"),
        (3, clash),  # the same name slot twice, with two names
        (4, "A train with Maria leaves the northern station, said nobody at all in this text of plain words"),
        (5, ITEM.upper()),
        (6, "before seven plain words make one small item after"),
        (7, "1 2 3 4 5 6 7 8 9 10 11 12 13"),
        (8, " ".join(ITEM.split()[4:20])),
        (None, "x an item that has no number of its own but many plain words"),
    ]
    got = found(docs(rows), benchmark)
    assert {(1, 1), (2, 1), (6, 5), (8, 1), (None, None)} <= got
    assert not {i for i, _ in got} & {3, 4, 7}


def test_odd_rows(docs, odd, empty, benchmark, spark):
    none = benchmark.filter("item_id = 99")
    assert found(odd, benchmark) == set() and found(empty, benchmark) == set() and found(odd, none) == set()
    assert decontamination.clean(odd, benchmark).count() == odd.count()
    long = docs([(1, "w " * 60_000 + ITEM), (1, "w " * 60_000 + ITEM), (2, "plain")])
    assert found(long, benchmark) == {(1, 1)}
    kept = decontamination.clean(long, benchmark)
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_verbatim_items_in_the_test_data(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    squeezed = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    texts = {r.doc_id: f" {squeezed(r.text)} " for r in docs.collect()}
    want = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if f" {squeezed(r.text)} " in t}
    got = found(docs, items)
    assert want and want <= got
    # Whatever else is found shares a run of 13 words or half the item, as the rule says.
    words = {r.item_id: squeezed(r.text).split() for r in items.collect()}
    for d, i in got - want:
        need = min(13, len(words[i]) // 2 + 1)
        assert any(f" {' '.join(words[i][k : k + need])} " in texts[d] for k in range(len(words[i]) - need + 1))


def test_filter_only_spares_work(docs, benchmark, monkeypatch):
    rows = docs([(k, ITEM if k % 5 == 0 else f"filler text number {k} " * 5) for k in range(40)])
    items = decontamination.item_windows(benchmark)
    monkeypatch.setattr(decontamination, "FILTER_BITS", 1)  # nearly everything passes
    wide = decontamination.matching_windows(rows, items).count()
    got = found(rows, benchmark)
    monkeypatch.setattr(decontamination, "FILTER_BITS", 22)
    assert decontamination.matching_windows(rows, items).count() < wide and found(rows, benchmark) == got == {(k, 1) for k in range(0, 40, 5)}


def test_windows_of_repeated_items_count_once(benchmark):
    of_one = decontamination.item_windows(benchmark).filter("item_id = 1")
    assert of_one.count() == of_one.select("at").distinct().count() == of_one.agg(F.max("windows")).first()[0]


def test_copies_with_different_values_are_judged_apart(docs, benchmark):
    def variant(name, km, hours, rest):
        return ITEM.replace("Maria", name).replace("120 km", km).replace("3 hours", hours).replace("40", rest)

    first, second = variant("Peter", "95 miles", "2 hours", "15"), variant("Olga", "70 km", "5 days", "25")
    long = variant("Anna", "95 miles", "2 hours", "15").replace("Anna", "Anna Sofia Berg")
    clash = "A train with Peter leaves the northern station at 7 and travels 95 miles in 2 days before Olga changes to a slower line for 15 weeks"
    other = clash.replace("Peter", "Ivan").replace("Olga", "Nina")
    rows = [(1, f"{first}. {second}."), (2, f"{second}. {first}"), (3, f"{first}.\nSome words between them. {second}. {variant('Zoe', '9 km', '8 weeks', '77')}"), (4, f"{long}. {second}"), (5, f"{clash}. {other}.")]
    got = decontamination.contaminated(docs(rows), benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_items_without_a_window_are_found_literally(docs, spark):
    sums, chinese = "What is 12 + 7 * 3 - 4 / 2 ?", "小明有三个苹果，又买了五个，一共有几个苹果？"
    items = [(1, sums), (2, chinese), (3, "Who wrote Hamlet?"), (4, "the sea"), (5, "12 13 14 15 16 17"), (6, "?!"), (None, "Name three noble gases")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, f"Before it. {sums} And after it"),
        (2, f"前面的句子。{chinese}后面的句子。"),
        (3, "They asked: who wrote\nHamlet, and when"),
        (4, "first line\nThe sea.\nlast line"),
        (5, "11 12 13 14 15 16 17 18"),
        (6, "What is 12 - 7 * 3 + 4 / 2 ?"),  # other signs
        (7, "What is 13 + 7 * 3 - 4 / 2 ?"),  # another number
        (8, "小明有三个苹果，又买了六个，一共有几个苹果？"),
        (9, "a walk along the sea and back"),  # two words inside a line
        (10, "12 13 14 15 17 16"),
        (11, "?! ?!"),
        (12, None),
        (None, "x name three noble gases y"),
        (13, "Who wrote"),
    ]
    assert found(docs(rows), bench) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (None, None)}
    kept = decontamination.clean(docs(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(6, 14)]


def test_wording_that_many_items_share_tells_nothing(spark, docs):
    """One instruction before every item: texts with the instruction alone are clean, and pairs grow with real copies only."""
    instruction = "Read the following passage with care and then choose the one best answer to the question below"
    own = [" ".join(f"q{k}x{chr(97 + n)}" for n in range(20)) for k in range(30)]
    own = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t) for t in own]
    items = [(k, f"{instruction} {t}") for k, t in enumerate(own)]
    alike = [(100 + k, f"what is the sum of {k + 2} apples and {3 * k + 7} pears in his large old basket") for k in range(20)]
    benchmark = spark.createDataFrame(items + alike, "item_id long, text string")
    filler = [" ".join(f"f{chr(97 + k % 26)}{chr(97 + n)}" for n in range(25)) for k in range(40)]
    rows = [(k, f"{filler[k]} {instruction} {filler[k][::-1]}") for k in range(40)]
    rows += [(50, f"{filler[0]} {own[3]}"), (51, items[7][1]), (52, "so what is the sum of 12 apples and 95 pears in his large old basket then")]
    got = found(docs(rows), benchmark)
    assert got == {(50, 3), (51, 7), (52, 100)}
    assert decontamination.clean(docs(rows), benchmark).count() == 40


def test_shared_wording_counts_in_pairs_and_like_items_have_rows(spark, docs):
    """Wording of ten items completes a copy that a telling window points to; items of the same shape all get their rows."""
    shared = ["one", "instruction", "before", "every", "item", "reads", "quite", "alike", "here", "and", "ends"]
    item = lambda k: " ".join([*shared, *[f"q{chr(97 + k)}{chr(97 + n)}" for n in range(12)]])
    items = [(k, item(k)) for k in range(10)]
    alike = [(100 + k, f"what is the sum of {k + 2} apples and {3 * k + 7} pears in his large old basket") for k in range(12)]
    benchmark = spark.createDataFrame(items + alike, "item_id long, text string")
    part = " ".join(item(4).split()[:14])  # four windows of shared wording, three telling ones of twelve
    rows = docs([(1, f"some talk {part} then other talk"), (2, " ".join(shared)), (3, "so " + alike[5][1])])
    got = decontamination.contaminated(rows, benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 4), (3, 100)}
    every = decontamination.with_members(got, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in every) == [(1, 4), *[(3, 100 + k) for k in range(12)]]


def test_words_are_read_alike_whatever_is_remembered(monkeypatch):
    from tidemark.llm import decontamination as dc

    texts = [b"The ten dogs ran 12km to Paris. Then home!", b"... -", b"", None, b"a b c d e f g. NASA \xff \xc3\x89cole", b"the kg of Salt"] * 2
    monkeypatch.setattr(dc, "MEMO_WORDS", 4)
    canon = dc.Canon()
    for text in texts:
        for got, want in zip(canon.template(text), dc.Canon().template(text)):
            assert got.tolist() == want.tolist()
    assert dc.Canon().template(texts[0])[2].tolist() == ["the", "ten", "dogs", "ran", "12km", "to", "paris", "then", "home"]
    assert dc.Canon().template(texts[0])[1].tolist() == [0, 1, 0, 0, 1, 0, 3, 0, 0]
    # Plain lower-case words need no normal form.
    monkeypatch.setattr(dc, "as_text", None)
    assert dc.Canon().template(b"ten plain words weigh two kg")[1].tolist() == [1, 0, 0, 0, 1, 2]
