"""ABC classification of product sales.

Products are ranked by sales, largest first, and classified by their cumulative share.
At *line* grain every order line is a ranked row that carries the whole sales of its
product; at *product* grain every product name is one row.

All lines of a product are equal and adjacent in the ranking, so one row per product says
everything: the k-th line of a product has the cumulative weight ``before + k * total``.
The reports are computed on that product frame, and only the line-grain listing is ever
as long as the order lines.
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.filters import Day, in_date_range
from depotlens.functions.scalars import percent, percent_text
from depotlens.operators.date_sums import date_bounds
from depotlens.operators.expand import expand_rows
from depotlens.operators.running_total import with_running_totals
from depotlens.plans.sales_store import stored_sales
from depotlens.sources.reader import Tables

Grain = Literal["line", "product"]

# Categories and the cumulative percentages at which they end.
CATEGORY_LIMITS = {"A": 20, "B": 50, "C": 100}

# weights exceed 64 bits: product totals times line counts
WIDE = "decimal(38,0)"


def _sales_by_code(tables: Tables, start: Day, end: Day, stored: str | None) -> DataFrame:
    """(product_code, quantity, line_count) of a date range.

    Lines meet their orders in the only join of two facts and are added up per product
    code right behind it. Skewed orders are split by adaptive execution. With ``stored``,
    the folder of stored daily sales, days are added up instead.
    """
    if stored is not None:
        days = stored_sales(tables["products"].sparkSession, stored, start, end)
        return days.groupBy("product_code").agg(
            F.sum("quantity").alias("quantity"), F.sum("line_count").alias("line_count"))
    orders = in_date_range(tables["orders"], "order_date", start, end).select("order_id")
    return (
        tables["order_details"].select("order_id", "product_code", "quantity")
        .join(orders, "order_id")
        .groupBy("product_code")
        .agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("line_count"))
    )


def product_sales(tables: Tables, start: Day = None, end: Day = None, grain: Grain = "line",
                  stored: str | None = None) -> DataFrame:
    """(product_name, total_sales, row_count): sales per product name and the number of
    report rows that stand for it.

    Product names join the sums per code. ``stored`` names the folder of sales kept by
    :mod:`depotlens.plans.sales_store`; then only products are needed beside it.
    """
    if grain not in ("line", "product"):
        raise ValueError(f"unknown grain {grain!r}")
    by_code = _sales_by_code(tables, start, end, stored)
    by_name = (
        by_code.join(tables["products"].select("product_code", "product_name"), "product_code")
        .groupBy("product_name")
        .agg(
            F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"),
            F.sum("line_count").alias("line_count"),
        )
    )
    # an unnamed product belongs to no group and has no total
    total = F.when(F.col("product_name").isNotNull(), F.col("quantity"))
    rows = F.col("line_count") if grain == "line" else F.lit(1).cast("bigint")
    return by_name.select("product_name", total.alias("total_sales"), rows.alias("row_count"))


def _ranking() -> list[Column]:
    """Largest sales first, equal sales by name, unnamed products last."""
    return [F.col("total_sales").isNull(), -F.col("total_sales"), F.col("product_name"), F.col("row_count")]


def _rows_within(limit: int) -> Column:
    """How many rows of a product have a cumulative share of at most ``limit`` percent.

    Compared in whole numbers as ``100 * cumulative <= limit * grand_total``. With falling
    cumulative sums (returns outweigh sales) the rows counted are the product's last ones.
    """
    step = "CAST(100 * CAST(total_sales AS DECIMAL(38,0)) AS DECIMAL(38,0))"
    room = f"CAST({limit} * grand_total - 100 * weight_before AS DECIMAL(38,0))"
    return F.expr(f"""
        CASE WHEN total_sales IS NULL OR grand_total <= 0 THEN 0L
             WHEN total_sales > 0 THEN
                 CASE WHEN {room} < {step} THEN 0L
                      WHEN {room} >= {step} * row_count THEN row_count
                      ELSE {room} div {step} END
             WHEN total_sales = 0 THEN IF({room} >= 0, row_count, 0L)
             ELSE
                 CASE WHEN {room} >= {step} THEN row_count
                      WHEN {room} < {step} * row_count THEN 0L
                      ELSE row_count - (-{room} - 1) div (-{step}) END
        END""")


def ranked_products(sales: DataFrame) -> DataFrame:
    """Products with the weight and the rows ranked before them and their rows up to each limit."""
    weight = F.coalesce(F.col("total_sales"), F.lit(0)).cast(WIDE) * F.col("row_count").cast(WIDE)
    ranked = with_running_totals(sales.withColumn("weight", weight.cast(WIDE)), _ranking(), {
        ("weight_before", "grand_total"): F.col("weight"), ("rows_before", "rows_total"): F.col("row_count")})
    limits = [0, *CATEGORY_LIMITS.values()]
    return ranked.select(
        "product_name", "total_sales", "row_count", "rows_before", "rows_total",
        *[F.col(c).cast(WIDE).alias(c) for c in ("weight_before", "grand_total")],
    ).withColumns({f"within_{x}": _rows_within(x) for x in limits})


def _category(position: Column) -> Column:
    """Category of the row at ``position`` in order of rising cumulative share; none at or
    below zero and none above the last limit."""
    picked = F.when(position <= F.col("within_0"), F.lit(None).cast("string"))
    for label, limit in CATEGORY_LIMITS.items():
        picked = picked.when(position <= F.col(f"within_{limit}"), label)
    return picked


def abc_report(tables: Tables, start: Day = None, end: Day = None, grain: Grain = "line",
               stored: str | None = None) -> DataFrame:
    """(product_name, total_sales, sales_pct, cumulative_pct, abc_category), largest first."""
    ranked = ranked_products(product_sales(tables, start, end, grain, stored)).withColumns({
        "before": F.col("weight_before").cast("double"),
        "grand": F.col("grand_total").cast("double"),
    }).drop("weight_before", "grand_total")
    if grain == "line":
        rows = expand_rows(ranked, "row_count", "k", _ranking(), "rows_before", "rows_total")
    else:
        rows = ranked.orderBy(*_ranking()).withColumn("k", F.lit(1).cast("bigint"))
    total = F.col("total_sales")
    position = F.when(total >= 0, F.col("k")).otherwise(F.col("row_count") + 1 - F.col("k"))
    return rows.select(
        "product_name",
        "total_sales",
        percent(total, F.col("grand")).alias("sales_pct"),
        percent(F.col("before") + F.col("k") * total.cast("double"), F.col("grand")).alias("cumulative_pct"),
        _category(position).alias("abc_category"),
    )


def abc_report_text(report: DataFrame) -> DataFrame:
    """The report as exported: shares as text with a percent sign."""
    return report.withColumns({c: percent_text(F.col(c)) for c in ("sales_pct", "cumulative_pct")})


def _category_counts(ranked: DataFrame) -> DataFrame:
    """One row: the number of report rows per category, and their total sales."""
    limits = [0, *CATEGORY_LIMITS.values()]
    counts = [
        F.coalesce(F.sum(F.col(f"within_{high}") - F.col(f"within_{low}")), F.lit(0)).alias(f"n_{label.lower()}")
        for label, low, high in zip(CATEGORY_LIMITS, limits, limits[1:])
    ]
    return ranked.agg(*counts, F.coalesce(F.max("grand_total"), F.lit(0)).cast(WIDE).alias("total_sales"))


def abc_summary(tables: Tables, start: Day = None, end: Day = None, grain: Grain = "line",
                stored: str | None = None) -> DataFrame:
    """(n_a, n_b, n_c, n_total, total_sales) over the report rows, without listing them."""
    counts = _category_counts(ranked_products(product_sales(tables, start, end, grain, stored)))
    return counts.select("n_a", "n_b", "n_c", (F.col("n_a") + F.col("n_b") + F.col("n_c")).alias("n_total"),
                         "total_sales")


def abc_distribution(tables: Tables, start: Day = None, end: Day = None, grain: Grain = "line",
                     stored: str | None = None) -> DataFrame:
    """(abc_category, pct): share of the report rows per category, largest first; all three
    categories appear."""
    summary = abc_summary(tables, start, end, grain, stored)
    rows = F.array(*[
        F.struct(F.lit(label).alias("abc_category"),
                 percent(F.col(f"n_{label.lower()}"), F.col("n_total")).alias("pct"))
        for label in CATEGORY_LIMITS
    ])
    return summary.select(F.inline(rows)).orderBy(F.desc("pct"), "abc_category")


def abc_top_product(tables: Tables, start: Day = None, end: Day = None, stored: str | None = None) -> DataFrame:
    """(product_name, total_sales) of the best-selling product; needs no ranking."""
    return (
        product_sales(tables, start, end, stored=stored)
        .where(F.col("total_sales").isNotNull())
        .select("product_name", "total_sales")
        .orderBy(F.desc("total_sales"), "product_name")
        .limit(1)
    )


def sales_date_bounds(tables: Tables) -> DataFrame:
    """(min_date, max_date) of the orders that have lines of known products."""
    orders = tables["orders"].select("order_id", "order_date")
    known = tables["order_details"].join(tables["products"].select("product_code"), "product_code", "left_semi")
    return date_bounds(orders.join(known.select("order_id"), "order_id", "left_semi"), "order_date")
