"""Stock rows below the safety stock of their product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.filters import Dates, matching_regex, on_dates, regex_found
from depotlens.operators.date_sums import sum_by_date
from depotlens.sources.reader import Tables


def short_rows(tables: Tables, *flags: Column) -> DataFrame:
    """Every stock row below its product's safety stock, on all dates; ``flags`` are extra
    columns computed once per product."""
    products = tables["products"]
    return (
        tables["warehouse_stock"]
        .select("stock_date", "product_code", "warehouse_id", "quantity_available")
        .join(products.select("product_code", "product_name", "safety_stock", *flags), "product_code")
        .where(F.col("quantity_available") < F.col("safety_stock"))
    )


def shortages(tables: Tables, dates: Dates = None, term: str | None = None) -> DataFrame:
    """(stock_date, product_name, quantity_available, safety_stock, missing_quantity),
    sorted by date and name.

    Each warehouse is compared on its own. The default date is the latest one that has a
    shortage. Code and warehouse follow in the sort order, which lets the rows of one
    date and name be spread over several tasks.
    """
    short = short_rows(tables)
    chosen = matching_regex(on_dates(short, "stock_date", dates), "product_name", term)
    return chosen.orderBy("stock_date", "product_name", "product_code", "warehouse_id").select(
        "stock_date", "product_name", "quantity_available", "safety_stock",
        (F.col("safety_stock") - F.col("quantity_available")).alias("missing_quantity"))


def shortages_view(report: DataFrame) -> DataFrame:
    """The shortage report as it is shown on screen, without its date."""
    return report.drop("stock_date")


def _sums(tables: Tables, dates: Dates, term: str | None, **sums: Column) -> DataFrame:
    """Sums over the short rows whose product matches; a date whose short rows all fail to
    match keeps its row with zeros."""
    short = short_rows(tables, regex_found("product_name", term).alias("wanted"))
    rows = on_dates(short, "stock_date", dates)
    return sum_by_date(rows, "stock_date", {n: F.when(F.col("wanted"), v) for n, v in sums.items()}, dates)


def _gap() -> Column:
    return F.abs(F.col("quantity_available") - F.col("safety_stock"))


def shortage_totals_by_date(tables: Tables, dates: Dates = None, term: str | None = None) -> DataFrame:
    """(stock_date, shortage): missing units per chosen date."""
    return _sums(tables, dates, term, shortage=_gap())


def shortage_bars(tables: Tables, dates: Dates = None, term: str | None = None) -> DataFrame:
    """(stock_date, available_sum, shortage_sum): the two bars of each chosen date, by date."""
    return _sums(tables, dates, term, available_sum=F.col("quantity_available"),
                 shortage_sum=_gap()).orderBy("stock_date")
