"""Directories on the storage that Spark reads, whatever its file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def partitions(spark: SparkSession, path: str, column: str) -> list[tuple[str, str]]:
    """(value, path) of the ``column=value`` directories below a table; none if the table is not there."""
    system, where = _at(spark, path)
    if not system.exists(where):
        return []
    found = [status.getPath() for status in system.listStatus(where)]
    named = [(p.getName(), p.toString()) for p in found]
    return [(name.removeprefix(f"{column}="), p) for name, p in named if name.startswith(f"{column}=")]


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a directory was written to its end."""
    system, where = _at(spark, f"{path}/_SUCCESS")
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a directory that may be missing; tells whether there was one."""
    system, where = _at(spark, path)
    return system.exists(where) and system.delete(where, True)
