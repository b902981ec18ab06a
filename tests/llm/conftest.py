import pathlib

import pytest
from pyspark.sql import DataFrame

ROOT = pathlib.Path(__file__).resolve().parents[2]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, fp long, ids string, start int, block string, n_words long, _id int"


@pytest.fixture(autouse=True, scope="session")
def workers_see_package(spark, tmp_path_factory):
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(ROOT))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def docs(spark):
    """Documents with further columns, whose names clash with those the operators use themselves."""

    def make(rows, lang="en") -> DataFrame:
        rows = [r if len(r) == 3 else (*r, lang) for r in rows]
        full = [(i, t, g, "src0", len(t or ""), 7, 7, "x", 7, "x", 7, 7) for i, t, g in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


ODD = [(None, "no id here"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "same text twice"), (5, "same text twice"), (6, "x" * 70_000), (7, "é ß 日本 😀 'tis IT'S")]


@pytest.fixture
def odd(docs):
    """Nulls, empty and long texts, repeated rows."""
    return docs(ODD)


@pytest.fixture
def empty(docs):
    return docs([])
