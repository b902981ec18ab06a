"""Stages of the pipeline: columns, decisions, odd rows; the whole against what each stage alone decides."""

import pytest

import corpus_pipeline
from plain_stages import kept_by_brute_force

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{number}")
        docs = spark.read.parquet(f"{root}/{number}")
        found.append(docs)
    return found


def test_columns(stages):
    assert [s.columns for s in stages[:5]] == [COLUMNS] * 5
    assert stages[5].columns[:2] == ["doc_id", "n_tokens"]


def test_decisions(spark, stages):
    before = [s.collect() for s in stages]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    for number in range(1, 5):
        want = kept_by_brute_force(number, before[number - 1], items)
        got = {r.doc_id: r.text for r in before[number]}
        assert got == want, corpus_pipeline.STAGES[number - 1][0]
    assert len(before[5]) == len(before[4]) < len(before[0])


def test_run_is_the_stages(spark, stages):
    rows = lambda df: sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[5])


@pytest.mark.parametrize("number", range(5))
@pytest.mark.parametrize("which", ["odd", "empty"])
def test_odd_rows(spark, request, number, which):
    docs = request.getfixturevalue(which)
    got = corpus_pipeline.STAGES[number][1](spark, docs, SF)
    assert got.count() <= docs.count()
    assert number == 4 or got.columns == COLUMNS
