"""The nine inventory tables derived from an order/line-item star schema.

The derivation is described in FIXTURES.md. Three tables carry a natural key instead of
a declared surrogate id, because the star schema has no unique line number. A delivery is
known by its order and supplier, so its id is text.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.functions.status import COMPLETED_LATE, COMPLETED_ON_TIME
from depotlens.sources.reader import LazyTables
from depotlens.sources.schemas import SPECS, TableSpec

IN_PROGRESS = "In progress"

_NATURAL_KEYS: dict[str, tuple[str, tuple[str, ...]]] = {
    "warehouse_stock": ("stock_id", ("stock_date", "product_code", "warehouse_id")),
    "order_details": ("order_product_id", ()),
    "delivery_details": ("delivery_detail_id", ("delivery_id", "product_code")),
}


def _natural(spec: TableSpec) -> TableSpec:
    surrogate, key = _NATURAL_KEYS.get(spec.name, (None, spec.key))
    kept = [f for f in spec.schema.fields if f.name != surrogate]
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "delivery_id" else f for f in kept])
    return replace(spec, schema=schema, key=key)


STAR_SPECS: dict[str, TableSpec] = {name: _natural(spec) for name, spec in SPECS.items()}

# file stem in the star schema -> main table derived from it
STAR_ROUTES = {
    "supplier": "suppliers",
    "part": "products",
    "nation": "warehouses",
    "customer": "customers",
    "orders": "orders",
    "lineitem": "order_details",
}


def _progress(is_open: Column, age: Column) -> Column:
    return F.when(is_open, IN_PROGRESS).when(age <= 14, COMPLETED_ON_TIME).otherwise(COMPLETED_LATE)


def _finished(is_open: Column, age: Column) -> Column:
    return F.when(~is_open, F.date_add(_order_date(), age.cast("int")))


def _order_date() -> Column:
    return F.col("o_orderdate").cast("date")


def _quantity() -> Column:
    return F.col("l_quantity").cast("bigint")


def _delivery_id() -> Column:
    """Text of the pair: no factor keeps numbers of the pair apart at every size."""
    return F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))


class StarSchema:
    """The inventory tables over ``directory``/*.parquet, one method per table."""

    def __init__(self, spark: SparkSession, directory: str):
        root = directory.rstrip("/")
        self._load = cache(lambda name: spark.read.parquet(f"{root}/{name}.parquet"))

    def suppliers(self) -> DataFrame:
        return self._load("supplier").select(
            F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"))

    def products(self) -> DataFrame:
        size = F.col("p_size")
        return self._load("part").select(
            F.col("p_partkey").alias("product_code"),
            F.col("p_name").alias("product_name"),
            size.alias("safety_stock"),
            size.alias("unit_height"),
            size.alias("unit_width"),
            size.alias("unit_depth"),
            (size * F.lit(0.25)).cast("decimal(5,2)").alias("unit_volume"),
        )

    def warehouses(self) -> DataFrame:
        return self._load("nation").select(
            F.col("n_nationkey").alias("warehouse_id"),
            F.col("n_name").alias("warehouse_name"),
            (F.col("n_nationkey") * 250).alias("capacity"),
        )

    def warehouse_stock(self) -> DataFrame:
        lines, places = self._load("lineitem"), self._load("supplier")
        reserved = F.when(F.col("l_linestatus") == "O", _quantity()).otherwise(F.lit(0))
        return (
            lines.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(
                F.trunc(F.col("l_shipdate").cast("date"), "month").alias("stock_date"),
                F.col("l_partkey").alias("product_code"),
                F.col("s_nationkey").alias("warehouse_id"),
            )
            .agg(F.sum(_quantity()).alias("quantity_on_hand"), F.sum(reserved).alias("quantity_reserved"))
            .withColumn("quantity_available", F.col("quantity_on_hand") - F.col("quantity_reserved"))
        )

    def customers(self) -> DataFrame:
        return self._load("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"))

    def orders(self) -> DataFrame:
        is_open = F.col("o_orderstatus") == "P"
        age = F.col("o_orderkey") % 30
        return self._load("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            _order_date().alias("order_date"),
            F.date_add(_order_date(), 14).alias("expected_shipping_date"),
            _finished(is_open, age).alias("shipping_date"),
            _progress(is_open, age).alias("shipping_status"),
            F.col("o_orderpriority").alias("sales_channel"),
        )

    def order_details(self) -> DataFrame:
        return self._load("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_code"),
            _quantity().alias("quantity"),
        )

    def deliveries(self) -> DataFrame:
        is_open = F.col("l_orderkey") % 7 == 0
        age = (F.col("l_orderkey") + F.col("l_suppkey")) % 30
        pairs = self._load("lineitem").select("l_orderkey", "l_suppkey").distinct()
        dated = self._load("orders").select("o_orderkey", "o_orderdate")
        return pairs.join(dated, F.col("l_orderkey") == F.col("o_orderkey")).select(
            _delivery_id().alias("delivery_id"),
            F.col("l_suppkey").alias("supplier_id"),
            _order_date().alias("order_date"),
            F.date_add(_order_date(), 14).alias("expected_delivery_date"),
            _finished(is_open, age).alias("delivery_date"),
            _progress(is_open, age).alias("delivery_status"),
        )

    def delivery_details(self) -> DataFrame:
        per_product = self._load("lineitem").groupBy("l_orderkey", "l_suppkey", "l_partkey").agg(
            F.sum(_quantity()).alias("quantity"))
        return per_product.select(
            _delivery_id().alias("delivery_id"), F.col("l_partkey").alias("product_code"), "quantity")


def star_tables(spark: SparkSession, directory: str) -> LazyTables:
    """All nine tables as lazy frames."""
    star = StarSchema(spark, directory)
    return LazyTables({name: getattr(star, name) for name in STAR_SPECS})
