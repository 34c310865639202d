"""The nine declared tables: columns, keys, constraints and storage layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class TableSpec:
    """One table: its schema, its key and the constraints declared on it."""

    name: str
    schema: T.StructType
    key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    # columns the stored table is partitioned by, so that a date filter prunes directories
    partition_by: tuple[str, ...] = ()
    # columns a catalog table is bucketed by, so that header and line tables join in place
    bucket_by: tuple[str, ...] = ()


_TYPES = {
    "BIGINT": T.LongType(),
    "INT": T.IntegerType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "DECIMAL(5,2)": T.DecimalType(5, 2),
}


def _struct(text: str) -> T.StructType:
    """Columns as in DDL; parsed here because Spark's own parser needs a running session."""
    columns = (column.split() for column in text.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])


SPECS: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        TableSpec(
            "suppliers",
            _struct("supplier_id BIGINT, supplier_name STRING"),
            key=("supplier_id",),
            not_null=("supplier_name",),
        ),
        TableSpec(
            "products",
            _struct("product_code BIGINT, product_name STRING, safety_stock INT, unit_height INT, "
                    "unit_width INT, unit_depth INT, unit_volume DECIMAL(5,2)"),
            key=("product_code",),
            not_null=("product_name",),
        ),
        TableSpec(
            "warehouses",
            _struct("warehouse_id INT, warehouse_name STRING, capacity INT"),
            key=("warehouse_id",),
            not_null=("warehouse_name",),
        ),
        TableSpec(
            "warehouse_stock",
            _struct("stock_id BIGINT, stock_date DATE, product_code BIGINT, warehouse_id INT, "
                    "quantity_on_hand BIGINT, quantity_reserved BIGINT, quantity_available BIGINT"),
            key=("stock_id",),
            foreign_keys=(
                ForeignKey("product_code", "products", "product_code"),
                ForeignKey("warehouse_id", "warehouses", "warehouse_id"),
            ),
            partition_by=("stock_date",),
        ),
        TableSpec(
            "customers",
            _struct("customer_id BIGINT, customer_name STRING"),
            key=("customer_id",),
            not_null=("customer_name",),
        ),
        TableSpec(
            "orders",
            _struct("order_id BIGINT, customer_id BIGINT, order_date DATE, expected_shipping_date DATE, "
                    "shipping_date DATE, shipping_status STRING, sales_channel STRING"),
            key=("order_id",),
            foreign_keys=(ForeignKey("customer_id", "customers", "customer_id"),),
            partition_by=("order_date",),
            bucket_by=("order_id",),
        ),
        TableSpec(
            "order_details",
            _struct("order_product_id BIGINT, order_id BIGINT, product_code BIGINT, quantity BIGINT"),
            key=("order_product_id",),
            foreign_keys=(
                ForeignKey("order_id", "orders", "order_id"),
                ForeignKey("product_code", "products", "product_code"),
            ),
            bucket_by=("order_id",),
        ),
        TableSpec(
            "deliveries",
            _struct("delivery_id BIGINT, supplier_id BIGINT, order_date DATE, expected_delivery_date DATE, "
                    "delivery_date DATE, delivery_status STRING"),
            key=("delivery_id",),
            foreign_keys=(ForeignKey("supplier_id", "suppliers", "supplier_id"),),
            partition_by=("order_date",),
            bucket_by=("delivery_id",),
        ),
        TableSpec(
            "delivery_details",
            _struct("delivery_detail_id BIGINT, delivery_id BIGINT, product_code BIGINT, quantity BIGINT"),
            key=("delivery_detail_id",),
            foreign_keys=(
                ForeignKey("delivery_id", "deliveries", "delivery_id"),
                ForeignKey("product_code", "products", "product_code"),
            ),
            bucket_by=("delivery_id",),
        ),
    )
}
