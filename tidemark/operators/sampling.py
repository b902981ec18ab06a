"""Exact minimum-gap sampling of a series: the first instant is kept, then always the first one at least the gap later.

What is kept depends on what was kept before, so no grouping by intervals gives it. Here every instant points to the first one
at least the gap after it; the kept ones are those on the pointer path of the first, found by doubling: with each round the
pointers jump twice as far and the known part of the path becomes twice as long. A series of n kept instants takes log2(n)
rounds of joins over distinct instants; no task sees more of the series than a stretch of ``BLOCK`` gaps, or one row for each
such stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import stored

#: Gaps in a stretch. Sparse series have one row for each stretch with an instant in the last look-ahead.
BLOCK = 1 << 16


def _next_filled(slots: DataFrame, wanted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(wanted, first): for every wanted slot the earliest instant in it or in the first filled slot after it."""
    filled = slots.select("slot", "first", F.lit(False).alias("asks"))
    both = filled.unionByName(wanted.select(F.col("wanted").alias("slot"), F.lit(None).cast("long").alias("first"), F.lit(True).alias("asks")))
    both = both.withColumn("block", F.floor(F.col("slot") / F.lit(block)))
    ahead = Window.partitionBy("block").orderBy("slot").rangeBetween(0, Window.unboundedFollowing)
    near = both.withColumn("first", F.min("first").over(ahead)).where("asks")
    starts = filled.groupBy(F.floor(F.col("slot") / F.lit(block)).alias("block")).agg(F.min("first").alias("start"))
    asked = near.where("first IS NULL").select("block").distinct().withColumn("start", F.lit(None).cast("long"))
    later = Window.orderBy("block").rangeBetween(1, Window.unboundedFollowing)
    following = starts.unionByName(asked).groupBy("block").agg(F.max("start").alias("start")).withColumn("start", F.min("start").over(later))
    return near.join(following, "block", "left").select(F.col("slot").alias("wanted"), F.coalesce("first", "start").alias("first"))


def pointers(instants: DataFrame, gap: int, block: int = BLOCK) -> DataFrame:
    """(t, next) for distinct whole-number instants ``t``: the first instant at least ``gap`` later, NULL for none."""
    placed = instants.select("t", F.floor(F.col("t") / F.lit(gap)).alias("slot"))
    # t + gap lies one slot on: the answer is in that slot, or is the first instant after it.
    asks = placed.select(F.col("t").alias("source"), (F.col("slot") + 1).alias("slot"), (F.col("t") + F.lit(gap)).alias("at"))
    targets = placed.select(F.lit(None).cast("long").alias("source"), "slot", F.col("t").alias("at"))
    ahead = Window.partitionBy("slot").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    hit = F.min(F.when(F.col("source").isNull(), F.col("at"))).over(ahead)
    found = asks.unionByName(targets).withColumn("hit", hit).where("source IS NOT NULL").select("source", (F.col("slot") + 1).alias("wanted"), "hit")
    slots = placed.groupBy("slot").agg(F.min("t").alias("first"))
    beyond = _next_filled(slots, found.where("hit IS NULL").select("wanted").distinct(), block)
    return found.join(beyond, "wanted", "left").select(F.col("source").alias("t"), F.coalesce("hit", "first").alias("next"))


def spaced(rows: DataFrame, gap_s: float, column: str = "ts", block: int = BLOCK) -> DataFrame:
    """The kept instants of ``column``, one row each. NULL is no instant; a gap of zero keeps all.

    Rounds are stored in the shared folder, so a lost executor costs one round.
    """
    gap = int(gap_s * 1_000_000)
    instants = rows.where(F.col(column).isNotNull()).select(F.unix_micros(column).alias("t")).distinct()
    if gap <= 0:
        return instants.select(F.timestamp_micros("t").alias(column))
    jumps = stored(pointers(instants, gap, block).where("next IS NOT NULL"))
    path = stored(instants.agg(F.min("t").alias("t")).where("t IS NOT NULL"))
    while True:
        onward = path.join(jumps, "t").select(F.col("next").alias("t"))
        if onward.isEmpty():
            return path.select(F.timestamp_micros("t").alias(column))
        path = stored(path.unionByName(onward))
        jumps = stored(jumps.join(jumps.select(F.col("t").alias("next"), F.col("next").alias("_far")), "next").select("t", F.col("_far").alias("next")))
