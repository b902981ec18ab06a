"""Help for joins whose other side may be dominated by a few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def split_ready(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows with rewritten text keys, so that Spark exchanges them again for a join.

    AQE splits a hot key only when both inputs come straight from an exchange that the join asked for. A side with one
    row per key that is already partitioned by key would skip that exchange. Not used for the large side; when the small
    side is broadcast nothing is exchanged at all.
    """
    text = [k for k in keys if dict(df.dtypes)[k] == "string"]
    return df.withColumns({k: F.concat(F.col(k), F.lit("")) for k in text}) if text else df
