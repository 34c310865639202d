"""Stored daily sales per product: the aggregate that all ABC reports share, kept up to date by period.

The stored table has one row per order date and product code and is partitioned by month. A refresh recomputes the
months of the dates that changed and replaces just their partitions, so its cost follows the changes and not the
history; reports add up days and never touch orders or their lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.functions.filters import Day, in_date_range, validate_range
from depotlens.sources.reader import Tables

SALES_SCHEMA = "order_date DATE, product_code BIGINT, quantity BIGINT, line_count BIGINT, order_month DATE"


def _month(column: str = "order_date"):
    return F.trunc(column, "month")


def daily_sales(tables: Tables, months: DataFrame | None = None) -> DataFrame:
    """(order_date, product_code, quantity, line_count, order_month) over dated orders; ``months``, a column
    ``order_month``, narrows it. The quantity is NULL only where all its lines have none.

    Lines without a product code belong to no report and are left out.
    """
    orders = in_date_range(tables["orders"], "order_date").select("order_id", "order_date", _month().alias("order_month"))
    if months is not None:
        orders = orders.join(months.select("order_month").distinct(), "order_month", "left_semi")
    lines = tables["order_details"].select("order_id", "product_code", "quantity")
    return (
        lines.where(F.col("product_code").isNotNull())
        .join(orders, "order_id")
        .groupBy("order_date", "product_code", "order_month")
        .agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("line_count"))
        .select("order_date", "product_code", "quantity", "line_count", "order_month")
    )


def refresh_sales(tables: Tables, path: str, dates: DataFrame | None = None) -> None:
    """Bring the stored sales under ``path`` up to date.

    ``dates``, with a column ``order_date``, lists the dates whose orders or lines changed, see :func:`changed_dates`;
    without it everything is computed anew. A month is replaced as a whole. Every named month gets a row without
    product, so that one that has lost all its sales replaces its partition as well instead of keeping old rows.
    A run that dies leaves old or new partitions and can be repeated.
    """
    if dates is None:
        daily_sales(tables).hint("rebalance", "order_month").write.mode("overwrite").partitionBy("order_month").parquet(path)
        return
    months = dates.where(F.col("order_date").isNotNull()).select(_month().alias("order_month")).distinct()
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (
        ("order_date", "date"), ("product_code", "bigint"), ("quantity", "bigint"), ("line_count", "bigint"))]
    marked = daily_sales(tables, months).unionByName(months.select(*none, "order_month"))
    marked.hint("rebalance", "order_month").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("order_month").parquet(path)


def stored_sales(spark: SparkSession, path: str, start: Day = None, end: Day = None) -> DataFrame:
    """The stored sales of a date range; only the partitions of its months are read."""
    first, last = validate_range(start, end)
    sales = spark.read.schema(SALES_SCHEMA).parquet(path)
    if first is not None:
        sales = sales.where(F.col("order_month") >= F.lit(first.replace(day=1)))
    if last is not None:
        sales = sales.where(F.col("order_month") <= F.lit(last))
    return in_date_range(sales, "order_date", first, last)


def _order_digests(tables: Tables) -> DataFrame:
    """(order_id, order_date, digest, line_count): what an order sells, independent of the order of its lines."""
    lines = tables["order_details"].where(F.col("product_code").isNotNull()).groupBy("order_id").agg(
        F.sum(F.xxhash64("product_code", "quantity").cast("decimal(38,0)")).alias("digest"),
        F.count(F.lit(1)).alias("line_count"))
    return tables["orders"].select("order_id", "order_date").join(lines, "order_id")


def changed_dates(before: Tables, after: Tables) -> DataFrame:
    """(order_date): dates whose sales differ between two versions of the tables.

    An order that was added, deleted, moved to another date or has other lines marks its dates on both sides. Each
    side is reduced to one row per order, and equal orders cancel out in one more count; whole tables are not joined.
    """
    sides = _order_digests(before).withColumn("side", F.lit(1)).unionByName(
        _order_digests(after).withColumn("side", F.lit(-1)))
    uneven = sides.groupBy("order_id", "order_date", "digest", "line_count").agg(F.sum("side").alias("side"))
    return uneven.where("side <> 0 AND order_date IS NOT NULL").select("order_date").distinct()
