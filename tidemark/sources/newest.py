"""Newest state by key in bucketed tables.

Rows are dealt to buckets by key when they are written, and read back by bucket: joins and aggregates on the key between
tables of as many buckets need no exchange, and one key is looked up in one bucket. A refresh joins the stored state with the
rows that came since, of which alone an exchange is made, and writes the next generation beside the one it read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.projection import VIEW_FIELDS, latest_view

KEY = "mint"


@dataclass(frozen=True)
class Bucketed:
    """A bucketed table below ``root``, one directory for each of two generations in turn."""

    root: str
    schema: T.StructType
    buckets: int
    generation: int = 0

    @property
    def path(self) -> str:
        return f"{self.root}/generation={self.generation % 2}"

    def _named(self, spark: SparkSession) -> str:
        """A table of this session over the files; the catalog keeps nothing else."""
        name = f"newest_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        where = self.path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
            f"INTO {self.buckets} BUCKETS LOCATION '{where}'"
        )
        spark.catalog.refreshTable(name)
        return name

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self._named(spark))

    def write(self, rows: DataFrame) -> Bucketed:
        """Write the next generation, one row per key, and give it. Rows are written where they are: a frame that joins bucketed
        tables gives one file for each bucket."""
        after = replace(self, generation=self.generation + 1)
        name = after._named(rows.sparkSession)
        rows.select(*self.schema.names).write.insertInto(name, overwrite=True)
        rows.sparkSession.catalog.refreshTable(name)
        return after


def create(root: str, rows: DataFrame, buckets: int) -> Bucketed:
    """A bucketed table of rows with one per key. With fewer buckets than ``spark.sql.shuffle.partitions`` Spark may exchange
    the buckets after all, to work on more tasks."""
    return Bucketed(root, rows.schema, buckets).write(rows.repartition(buckets, KEY))


def create_newest(root: str, current: DataFrame, buckets: int) -> Bucketed:
    """The newest row per key of a ``current_view``."""
    return create(root, latest_view(current), buckets)


def merged(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Newest row per key of a stored state and of history rows that came since, in any order; at one instant the stored row
    stays. The stored side is not exchanged if it is bucketed."""
    fields = ("observed_at", *VIEW_FIELDS)
    fresh = latest_view(added).select(KEY, F.struct(*fields).alias("_new"))
    both = stored.join(fresh, KEY, "full_outer")
    takes = F.col("observed_at").isNull() | (F.col("_new.observed_at") > F.col("observed_at"))
    return both.select(KEY, *[F.when(F.coalesce(takes, F.lit(False)) & F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def refresh(spark: SparkSession, table: Bucketed, added: DataFrame) -> Bucketed:
    """The next generation of a table of ``create_newest`` with the rows that came since."""
    return table.write(merged(table.read(spark), added))
