"""Bucketed newest state: results, and plans without an exchange of the stored side."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import feed, projection as pr
from tidemark.plans import fixtures as fx
from tidemark.sources import newest
from tests.test_plans import options, plan

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def tables(spark, tmp_path):
    rows = fx.current_rows(spark, SF, fx.FULL)
    known = F.col("observed_at") <= F.lit(fx.BEFORE).cast("timestamp")
    first = newest.create_newest(str(tmp_path / "newest"), rows.where(known), 4)
    registry = newest.create(str(tmp_path / "registry"), fx.registry(spark, SF, fx.FULL), 4)
    return rows, known, first, registry


def collected(df):
    return sorted(map(str, df.collect()))


def test_refresh_equals_the_fold_over_everything(spark, tables):
    rows, known, first, _ = tables
    assert collected(first.read(spark)) == collected(pr.latest_view(rows.where(known)).select(*first.schema.names))
    second = newest.refresh(spark, first, rows.where(~known))
    assert collected(second.read(spark)) == collected(pr.latest_view(rows).select(*first.schema.names))
    again = newest.refresh(spark, second, rows.where(known))  # old rows come late, and rows come twice
    assert collected(again.read(spark)) == collected(second.read(spark))
    assert again.path == first.path != second.path


def test_no_exchange_of_the_stored_side(spark, tables, capsys):
    rows, known, first, registry = tables
    with options(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="4"):
        state, facts = first.read(spark), registry.read(spark)
        population = pr.project_newest(facts, state, fx.FULL)
        text = plan(population)
        assert "Exchange" not in text and "SortMergeJoin" in text
        merged = plan(newest.merged(state, rows.where(~known)))
        assert merged.count("Exchange") == 1 and "partial_max_by" in merged.split("Exchange")[1].splitlines()[1]
        second = newest.refresh(spark, first, rows.where(~known))
        assert len([f for f in os.listdir(second.path) if f.startswith("part-")]) <= 4
        fields = {f: population[f] for f in schemas.TOKEN_FIELDS}
        tokens = newest.create(first.root + "-tokens", population.select(*fields), 4)
        later = tokens.write(tokens.read(spark).withColumn("liquidity", F.col("liquidity") + 1))
        diff = feed.population_diff(tokens.read(spark), later.read(spark))
        assert "Exchange" not in plan(diff)
        changed = state.where("liquidity IS NOT NULL").join(facts.where("tracking_enabled"), "mint").count()
        assert diff.where("type = 'token_updated'").count() == changed > 0
        key = state.first().mint
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        try:
            state.where(F.col("mint") == key).explain("formatted")
        finally:
            spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        assert "1 out of 4" in capsys.readouterr().out


def test_ties_and_unknown_instants(spark, tmp_path):
    at = datetime(2024, 5, 1)
    schema = fx.current_rows(spark, SF, fx.FULL).schema

    def rows(*values):
        return spark.createDataFrame([(m, t, n, *[None] * (len(schema) - 3)) for m, t, n in values], schema)

    table = newest.create_newest(str(tmp_path / "t"), rows(("a", at, "old"), ("b", at, "old")), 2)
    after = newest.refresh(spark, table, rows(("a", at, "same instant"), ("b", at + timedelta(seconds=1), "new"), ("c", at, "first")))
    assert {r.mint: r.name for r in after.read(spark).collect()} == {"a": "old", "b": "new", "c": "first"}
    empty = newest.refresh(spark, after, rows())
    assert collected(empty.read(spark)) == collected(after.read(spark))
