"""Minimum-gap sampling against a sequential fold."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sampling
from tests.test_plans import plan


def fold(values, gap):
    kept = []
    for v in sorted(set(values)):
        if not kept or v >= kept[-1] + gap:
            kept.append(v)
    return kept


@pytest.mark.parametrize("seed, block", [(1, sampling.BLOCK), (2, 2)])
def test_equals_a_sequential_fold(spark, seed, block):
    draw, values, at = random.Random(seed), [], -7_000_000
    for _ in range(300):  # dense stretches, exact gaps, long silences, instants before 1970
        at += draw.choice([1, 300_000, 999_999, 1_000_000, 1_000_001, 2_500_000, 400_000_000])
        values += [at] * draw.choice([1, 1, 3])
    rows = spark.createDataFrame([(v,) for v in values], "v long").select(F.timestamp_micros("v").alias("ts"))
    got = sorted(r.v for r in sampling.spaced(rows, 1.0, block=block).select(F.unix_micros("ts").alias("v")).collect())
    assert got == fold(values, 1_000_000)


def test_edges(spark):
    def kept(values, gap):
        rows = spark.createDataFrame([(v,) for v in values], "v long").select(F.timestamp_micros("v").alias("ts"))
        return sorted(r.v for r in sampling.spaced(rows, gap).select(F.unix_micros("ts").alias("v")).collect())

    assert kept([], 1) == [] and kept([None], 1) == [] and kept([5, None, 5], 1) == [5]
    assert kept([0, 3, 1], 0) == [0, 1, 3]
    assert kept([0, 999_999, 1_000_000, 1_999_999, 2_000_000], 1) == [0, 1_000_000, 2_000_000]


def test_no_window_over_the_series(spark):
    instants = spark.range(100).select(F.col("id").alias("t"))
    windows = [line for line in plan(sampling.pointers(instants, 10)).splitlines() if "windowspecdefinition" in line]
    assert windows and all("windowspecdefinition(slot" in w or "windowspecdefinition(block" in w for w in windows)
