"""Row counts and bounds of stored tables from Parquet footers: no row group is read.

Parquet keeps the number of rows and the smallest and largest value of every column chunk in the footer of a file. The
Data Source V2 reader answers counts, minima and maxima from them if no filter is in the way. Values of a partition
column are in no file: they are counted per directory first, so that an empty directory counts for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

V1_SOURCES = "spark.sql.sources.useV1SourceList"
PUSH_DOWN = "spark.sql.parquet.aggregatePushdown"


@contextmanager
def _second_reader(spark: SparkSession) -> Iterator[None]:
    """Tables that are opened inside are read by the Data Source V2 reader; others keep theirs."""
    before = spark.conf.get(V1_SOURCES)
    spark.conf.set(V1_SOURCES, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        yield
    finally:
        spark.conf.set(V1_SOURCES, before)


def footer_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table whose counts and bounds come from footers. The session's setting for that is switched on."""
    spark.conf.set(PUSH_DOWN, "true")
    with _second_reader(spark):
        return spark.read.parquet(path)


def row_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(table_name, row_count) of every stored table."""
    counts = [
        footer_table(spark, path).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def column_bounds(spark: SparkSession, path: str, column: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """(min_value, max_value) of a date or number column; NULL for a table without rows."""
    table, value = footer_table(spark, path), column
    if column in partition_by:
        table = table.groupBy(column).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 0")
    return table.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def stored_bounds(spark: SparkSession, columns: Mapping[str, tuple[str, str, Sequence[str]]]) -> DataFrame:
    """(table_name, min_value, max_value): for each table its path, column and partition columns."""
    found = [
        column_bounds(spark, path, column, partition_by).select(F.lit(name).alias("table_name"), "min_value", "max_value")
        for name, (path, column, partition_by) in columns.items()
    ]
    return reduce(DataFrame.unionByName, found)
