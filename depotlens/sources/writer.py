"""Sinks: stored table versions and named report exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from depotlens.sources.schemas import TableSpec

# Names of the report exports.
REPORT_NAMES = (
    "inventory_status",
    "inventory_shortages",
    "abc_analysis",
    "supplier_timeliness",
    "customer_timeliness",
    "delivery_lead_time",
    "shipping_lead_time",
)

# Report headings that are not just the column name in title case.
HEADINGS = {
    "delivery_id": "Delivery Number",
    "order_id": "Order Number",
    "sales_pct": "Sales Percentage",
    "cumulative_pct": "Cumulative Percentage",
    "abc_category": "ABC Category",
    "lead_time_days": "Lead Time (days)",
}


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write one table version as Parquet.

    ``rebalance`` brings the rows of a partition value together so that few files are
    written per value, and still splits a value that holds most of the rows.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_counted(df: DataFrame, path: str, spec: TableSpec) -> DataFrame:
    """Write one table version and return (table, rule, column, violations) of its NOT NULL rules and, as rule
    ``row_count``, its number of rows.

    The figures are gathered while the rows pass by on their way into the files, so nothing is read a second time.
    """
    checked = tuple(dict.fromkeys((*spec.key, *spec.not_null)))
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[
        F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in checked])
    write_table(counted, path, spec.partition_by)
    found = seen.get
    rows = [(spec.name, "not_null", c, found[f"nulls_{c}"]) for c in checked] + [(spec.name, "row_count", "", found["rows"])]
    return df.sparkSession.createDataFrame(rows, "table string, rule string, column string, violations bigint")


def save_table(df: DataFrame, name: str, spec: TableSpec, buckets: int, by_date: bool = False) -> None:
    """Save a catalog table in the layout its joins want.

    Header and line tables are bucketed alike on the key they share, so that their join
    needs no shuffle; choose ``buckets`` so that one bucket of the larger table fits a
    task. Tables without a bucket key are partitioned as in :func:`write_table`. ``by_date``
    partitions bucketed tables by their date as well: a date range then reads its directories
    only and still joins in place. Every date holds up to ``buckets`` files.
    """
    if spec.bucket_by and spec.partition_by and by_date:
        shuffled = df.repartition(buckets, *spec.bucket_by).sortWithinPartitions(*spec.partition_by)
        shuffled.write.mode("overwrite").partitionBy(*spec.partition_by).bucketBy(
            buckets, *spec.bucket_by).sortBy(*spec.bucket_by).saveAsTable(name)
    elif spec.bucket_by:
        shuffled = df.repartition(buckets, *spec.bucket_by)
        shuffled.write.mode("overwrite").bucketBy(buckets, *spec.bucket_by).sortBy(*spec.bucket_by).saveAsTable(name)
    elif spec.partition_by:
        balanced = df.hint("rebalance", *spec.partition_by)
        balanced.write.mode("overwrite").partitionBy(*spec.partition_by).saveAsTable(name)
    else:
        df.write.mode("overwrite").saveAsTable(name)


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append rows to a stored table."""
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("append").parquet(path)


def with_headings(df: DataFrame) -> DataFrame:
    """Column names as they are shown to people."""
    return df.toDF(*[HEADINGS.get(c, c.replace("_", " ").title()) for c in df.columns])


def export_report(df: DataFrame, directory: str, name: str, fmt: str = "csv") -> str:
    """Write a report to ``directory/name`` and return that path.

    CSV carries display headings; Parquet keeps the column names for further queries.
    """
    if name not in REPORT_NAMES:
        raise ValueError(f"unknown report {name!r}, expected one of {REPORT_NAMES}")
    path = f"{directory.rstrip('/')}/{name}"
    if fmt == "csv":
        with_headings(df).write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")
    return path
