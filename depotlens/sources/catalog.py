"""Listings of tables and of the files they are loaded from."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.functions.scalars import fixed_text
from depotlens.sources.reader import Tables
from depotlens.sources.schemas import SPECS

# Fixed value: how modification times are shown.
MODIFIED_FORMAT = "dd-MM-yyyy HH:mm:ss"
BYTES_PER_MB = 1024 * 1024
INVENTORY_SCHEMA = "table_name STRING, size_mb DOUBLE, modified STRING"


def register_views(tables: Tables, prefix: str = "") -> None:
    """Make the tables available to ``spark.sql`` under ``prefix`` + name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def table_catalog(spark: SparkSession, prefix: str = "") -> DataFrame:
    """Names of the tables in the current catalog that begin with ``prefix``."""
    listed = spark.sql("SHOW TABLES").select(F.col("tableName").alias("table_name"))
    return listed.where(F.col("table_name").startswith(prefix))


def query(spark: SparkSession, tables: Tables, sql: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """Run SQL over the tables. ``{name}`` stands for a table and ``:name`` for a bound
    value, so that no value is ever pasted into the text."""
    used = {name: tables[name] for name in tables if f"{{{name}}}" in sql}
    return spark.sql(sql, dict(args or {}), **used)


def row_counts(tables: Tables, prefix: str = "") -> DataFrame:
    """One row per table with its number of rows."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(prefix + name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def browse_table(tables: Tables, name: str, limit: int | None = None) -> DataFrame:
    """All rows and columns of a table; ``limit`` is for on-screen previews."""
    if name not in tables:
        raise ValueError(f"unknown table {name!r}, expected one of {sorted(tables)}")
    df = tables[name]
    return df if limit is None else df.limit(limit)


def source_inventory(spark: SparkSession, directory: str, fmt: str = "parquet",
                     routes: Mapping[str, str] | None = None) -> DataFrame:
    """Size and last modification of every routed source that exists.

    ``routes`` maps a file stem to a table name. A source may be one file or a directory
    of part files, so lengths are added up per source. File contents are never read.
    """
    routes = routes or {name: name for name in SPECS}
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], INVENTORY_SCHEMA)
        raise
    # "<stem>.<fmt>" is either the file itself or one of the directories above a part file
    stem = F.regexp_extract("path", rf"/([^/]+)\.{fmt}(?:/.*)?$", 1)
    table_of = F.create_map(*[F.lit(text) for pair in routes.items() for text in pair])
    return (
        files.select(F.try_element_at(table_of, stem).alias("table_name"), "length", "modificationTime")
        .where(F.col("table_name").isNotNull())
        .groupBy("table_name")
        .agg(
            (F.sum("length") / F.lit(BYTES_PER_MB)).alias("size_mb"),
            F.date_format(F.max("modificationTime"), MODIFIED_FORMAT).alias("modified"),
        )
    )


def source_inventory_text(inventory: DataFrame) -> DataFrame:
    """The listing as shown on screen: sizes in MB with two decimals."""
    return inventory.withColumn("size_mb", F.concat(fixed_text(F.col("size_mb")), F.lit(" MB")))
