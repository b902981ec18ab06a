"""Exact interpolated quantiles over groups of any size.

The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here ranges are narrowed by counts, the
same way at every size: a mergeable sketch proposes a range around each wanted rank; exact counts say whether the rank lies
in it, below or above, so a proposal that misses is widened to that side; a grid of further sketched values cuts the range
into cells, of which the counts pick one; only the values of that cell are ranked. With ``ACCURACY`` and ``CELLS`` a cell has
about a hundred-thousandth of the rows. The sketches decide how much is looked at, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.joins import split_ready

ACCURACY = 10_000
CELLS = 100


def _spread(rows: DataFrame, figures: Column, by: Sequence[str], name: str) -> DataFrame:
    """The rows with one struct of figures over their group."""
    if by:
        side = split_ready(rows.groupBy(*by).agg(figures.alias(name)), *by).withColumnsRenamed({c: f"_of_{c}" for c in by})
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
        return rows.join(side, same).drop(*(f"_of_{c}" for c in by))
    return rows.withColumn(name, rows.agg(figures.alias(name)).scalar())


def _ends(i: int) -> tuple[Column, Column]:
    """The range that the sketch proposes for a probability."""
    everything = F.lit(float("inf"))
    return F.coalesce(F.col("_s.ends")[2 * i], -everything), F.coalesce(F.col("_s.ends")[2 * i + 1], everything)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per group with one column per named probability; groups without a known value are absent.

    NaN and infinite values are ignored; NULL is a group like any other. Without ``by`` the result is one row, with NULLs when nothing is known.
    """
    by = list(by)
    number, margin = F.col(value).cast("double"), 5.0 / accuracy
    # NaN sorts above infinity, so one comparison leaves out NULL, NaN and infinities.
    rows = df.select(*by, number.alias("_v")).where(F.abs("_v") < F.lit(float("inf")))

    ends = [end for q in probabilities.values() for end in (max(0.0, q - margin), min(1.0, q + margin))]
    proposed = F.struct(F.count("_v").alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("ends"))
    rows = _spread(rows, proposed, by, "_s")

    figures = []
    for i in range(len(probabilities)):
        low, high = _ends(i)
        inside = F.col("_v").between(low, high)
        grid = F.percentile_approx(F.when(inside, F.col("_v")), F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)]), F.lit(accuracy))
        figures.append(F.struct(F.count_if(F.col("_v") < low).alias("below"), F.count_if(inside).alias("inside"), grid.alias("grid")))
    counted = _spread(rows, F.array(*figures), by, "_c")

    ranges, everything = [], F.lit(float("inf"))
    for i, q in enumerate(probabilities.values()):
        c, (low, high) = F.col("_c")[i], _ends(i)
        position = F.lit(float(q)) * (F.col("_s.n") - 1)
        first, last = F.floor(position), F.ceil(position)
        under, over = first < c["below"], last >= c["below"] + c["inside"]
        ranges.append(
            F.struct(
                F.lit(i).alias("i"),
                position.alias("position"),
                # A neighbouring rank beyond the end widens the range, it never leaves the query without an answer.
                F.when(under, -everything).otherwise(low).alias("low"),
                F.when(over, everything).otherwise(high).alias("high"),
                F.when(under, F.lit(0)).otherwise(c["below"]).alias("below"),
                c["grid"].alias("grid"),
            )
        )
    wanted = counted.select(*by, "_v", F.explode(F.array(*ranges)).alias("_r")).where(F.col("_v").between(F.col("_r.low"), F.col("_r.high")))
    cell = F.coalesce(F.aggregate("_r.grid", F.lit(0), lambda n, g: n + F.when(g < F.col("_v"), 1).otherwise(0)), F.lit(0))
    part = [*by, "_i"]
    values = (
        wanted.select(*by, F.col("_r.i").alias("_i"), F.col("_r.position").alias("_p"), F.col("_r.below").alias("_below"), cell.alias("_cell"), "_v")
        .groupBy(*part, "_p", "_below", "_cell", "_v")
        .agg(F.count("*").alias("_n"))
    )
    # At most CELLS rows for each probability.
    cells = values.groupBy(*part, "_p", "_below", "_cell").agg(F.sum("_n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*part).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_before", F.col("_below") + before)
    holds = [(F.col("_before") <= rank) & (F.col("_before") + F.col("_n") > rank) for rank in (F.floor("_p"), F.ceil("_p"))]
    cells = cells.where(holds[0] | holds[1]).select(*[F.col(c).alias(f"_on_{c}") for c in part], F.col("_cell").alias("_on_cell"), "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in part]
    inside = values.join(cells, [*same, F.col("_cell") == F.col("_on_cell")])
    order = Window.partitionBy(*part, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_end", F.col("_before") + F.sum("_n").over(order))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_end") - F.col("_n") <= rank) & (F.col("_end") > rank), F.col("_v")))

    weight = F.max(F.col("_p") - F.floor("_p"))
    picked = ranked.groupBy(*part).agg((at(F.floor("_p")) * (1 - weight) + at(F.ceil("_p")) * weight).alias("_q"))
    columns = [F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(probabilities)]
    return picked.groupBy(*by).agg(*columns) if by else picked.agg(*columns)
