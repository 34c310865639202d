"""How full each warehouse is on one date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.functions.filters import Day, Names, named, on_dates
from depotlens.functions.scalars import FILL_COLOURS, FILL_THRESHOLDS, band, percent, round_half_away
from depotlens.sources.reader import Tables


def fill_levels(tables: Tables, date: Day = None, warehouses: Names = None) -> DataFrame:
    """(warehouse_name, fill_percentage, band); the latest stock date by default.

    Warehouses of the same name and capacity count as one, a warehouse without stock on
    the date is absent, and more than 100 % is possible.

    Quantities are added up as plain integers per warehouse and unit volume, so decimal
    arithmetic and the warehouse join see a few sums instead of every stock row.
    """
    stock = on_dates(tables["warehouse_stock"], "stock_date", [date] if date else None)
    places = named(tables["warehouses"], "warehouse_name", warehouses)
    volumes = (
        stock.select("product_code", "warehouse_id", "quantity_available")
        .join(tables["products"].select("product_code", "unit_volume"), "product_code")
        .groupBy("warehouse_id", "unit_volume")
        .agg(F.sum("quantity_available").alias("quantity"))
    )
    filled = (
        volumes.join(places, "warehouse_id")
        .groupBy("warehouse_name", "capacity")
        .agg(F.sum(F.col("unit_volume") * F.col("quantity")).alias("volume"))
    )
    pct = round_half_away(percent(F.col("volume"), F.col("capacity")), 2)
    return filled.select("warehouse_name", pct.alias("fill_percentage")).withColumn(
        "band", band(F.col("fill_percentage"), FILL_THRESHOLDS, FILL_COLOURS))
