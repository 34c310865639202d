"""Available stock per product and warehouse, and its course over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.functions.filters import ALL_DATES, Dates, Names, matching_like, named, on_dates
from depotlens.operators.date_sums import sum_by_date
from depotlens.sources.reader import Tables


def stock_status(tables: Tables, dates: Dates = None, warehouses: Names = None,
                 term: str | None = None) -> DataFrame:
    """(stock_date, product_name, warehouse_name, quantity_available).

    The filters sit on the tables they belong to, below the joins.
    """
    stock = on_dates(tables["warehouse_stock"], "stock_date", dates)
    products = matching_like(tables["products"], "product_name", term)
    places = named(tables["warehouses"], "warehouse_name", warehouses)
    return (
        stock.select("stock_date", "product_code", "warehouse_id", "quantity_available")
        .join(products.select("product_code", "product_name"), "product_code")
        .join(places.select("warehouse_id", "warehouse_name"), "warehouse_id")
        .select("stock_date", "product_name", "warehouse_name", "quantity_available")
    )


def stock_totals_by_date(tables: Tables, dates: Dates = None, warehouses: Names = None,
                         term: str | None = None) -> DataFrame:
    """(stock_date, total_available) over the rows of :func:`stock_status`; a chosen date
    without such rows has total 0.

    Dates asked for by name are known, so inner joins drop what the filters exclude. Otherwise
    outer joins keep those stock rows, with nothing to add, so the dates do not have to be
    looked up in a second scan.
    """
    asked = isinstance(dates, DataFrame) or (dates and dates != ALL_DATES)
    how = "inner" if asked else "left"
    stock = on_dates(tables["warehouse_stock"], "stock_date", dates)
    products = matching_like(tables["products"], "product_name", term)
    places = named(tables["warehouses"], "warehouse_name", warehouses)
    rows = (
        stock.select("stock_date", "product_code", "warehouse_id", "quantity_available")
        .join(products.select("product_code", F.lit(True).alias("has_product")), "product_code", how)
        .join(places.select("warehouse_id", F.lit(True).alias("has_place")), "warehouse_id", how)
    )
    counted = F.when(F.col("has_product") & F.col("has_place"), F.col("quantity_available"))
    return sum_by_date(rows, "stock_date", {"total_available": counted}, dates)


def stock_trend(tables: Tables, dates: Dates = None, warehouses: Names = None,
                term: str | None = None) -> DataFrame:
    """(stock_date, warehouse_name, quantity_available) summed per warehouse name.

    The product filter does not narrow the sums. It only decides whether there is a trend
    to show: if it leaves no stock rows, the result is empty.

    Rows are summed per warehouse id before names are looked up, so the join handles one
    row per date and warehouse. Whether a product matches travels with the sums, so the
    stock is read once.
    """
    stock = on_dates(tables["warehouse_stock"], "stock_date", dates)
    places = named(tables["warehouses"], "warehouse_name", warehouses)
    products = matching_like(tables["products"], "product_name", term)
    by_id = (
        stock.select("stock_date", "product_code", "warehouse_id", "quantity_available")
        .join(products.select("product_code", F.lit(1).alias("matched")).distinct(), "product_code", "left")
        .groupBy("stock_date", "warehouse_id")
        .agg(F.sum("quantity_available").alias("quantity"), F.max("matched").alias("matched"))
    )
    trend = (
        by_id.join(places.select("warehouse_id", "warehouse_name"), "warehouse_id")
        .groupBy("stock_date", "warehouse_name")
        .agg(F.sum("quantity").alias("quantity_available"), F.max("matched").alias("matched"))
    )
    return trend.where(trend.agg(F.max("matched")).scalar() == 1).drop("matched")
