"""Registered queries that go through stored tables and files: what is derived from the given tables is written to the
shared folder, in a folder of its own per call, and read back by the library."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotlens.operators import bucket_sync
from depotlens.operators.sync import sync_all
from depotlens.plans import abc, lead_time, sales_store, stock
from depotlens.plans.party import CUSTOMER, SUPPLIER
from depotlens.session import shared_folder
from depotlens.sources import catalog, footers, reader, writer
from depotlens.sources.schemas import SPECS
from depotlens.sources.star_schema import STAR_ROUTES, STAR_SPECS, star_tables

Query = Callable[[SparkSession, str], DataFrame]
RANGE = ("1995-03-10", "1998-08-20")
BUCKETS = 16


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def refreshed_sales(spark: SparkSession, tables) -> str:
    """Stored sales that were built before the newest orders and lines arrived, and refreshed afterwards."""
    path = new_folder(spark, "daily-sales")
    before = dict(tables) | {
        "orders": tables["orders"].where(F.col("order_date") < F.lit("1998-01-01").cast("date")),
        "order_details": tables["order_details"].where(
            (F.col("order_id") % 50 != 7) | ~F.col("order_id").between(1000, 3000))}
    sales_store.refresh_sales(before, path)
    sales_store.refresh_sales(tables, path, sales_store.changed_dates(before, tables))
    return path


def _from_stored(job: Callable[..., DataFrame], *args, **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = star_tables(spark, sf_dir)
        return job(tables, *args, stored=refreshed_sales(spark, tables), **params)
    return run


def _abc_summary(tables, *args, **params) -> DataFrame:
    return abc.abc_summary(tables, *args, **params).withColumn("total_sales", F.col("total_sales").cast("double"))


def bucket_synced(spark: SparkSession, target: DataFrame, source: DataFrame) -> DataFrame:
    """Orders stored by bucket, synchronised with a newer export."""
    folder = new_folder(spark, "orders")
    bucket_sync.store_version(target, f"{folder}/v1", ["order_id"], BUCKETS)
    bucket_sync.sync_version(spark, f"{folder}/v1", source, f"{folder}/v2", ["order_id"])
    return bucket_sync.read_version(spark, f"{folder}/v2")


def stored_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the given files, from their footers."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    return footers.row_counts(spark, {n: f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names})


def stored_date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last date of stored orders and of stored stock, which is partitioned by its date."""
    tables, folder = star_tables(spark, sf_dir), new_folder(spark, "tables")
    for name, partition_by in (("orders", ()), ("warehouse_stock", ("stock_date",))):
        writer.write_table(tables[name], f"{folder}/{name}", partition_by)
    return footers.stored_bounds(spark, {
        "orders": (f"{folder}/orders", "order_date", ()),
        "warehouse_stock": (f"{folder}/warehouse_stock", "stock_date", ("stock_date",))})


def _delivery_months(tables) -> DataFrame:
    mine = tables["deliveries"].where(F.col("supplier_id") == 3)
    return mine.select(F.trunc("order_date", "month").alias("month"))


def _large_places(tables) -> DataFrame:
    return tables["warehouses"].where("capacity >= 3000").select("warehouse_name")


def stock_status_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock of the months in which a supplier delivered, in large warehouses: both choices are tables."""
    tables = star_tables(spark, sf_dir)
    return stock.stock_status(tables, _delivery_months(tables), _large_places(tables))


def stock_totals_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = star_tables(spark, sf_dir)
    return stock.stock_totals_by_date(tables, _delivery_months(tables), _large_places(tables), "ring")


def _csv_orders(spark: SparkSession, sf_dir: str) -> str:
    """An export of the orders as CSV in which some texts do not parse."""
    path = reader.source_path(new_folder(spark, "export"), "orders", "csv")
    text = star_tables(spark, sf_dir)["orders"].select(*[F.col(c).cast("string") for c in SPECS["orders"].schema.fieldNames()])
    number = F.col("order_id").cast("bigint")
    text.withColumns({
        "customer_id": F.when(number % 47 == 0, F.concat(F.lit("no. "), "customer_id")).otherwise(F.col("customer_id")),
        "order_date": F.when(number % 41 == 0, F.lit("soon")).otherwise(F.col("order_date")),
        "shipping_date": F.when(number % 43 == 0, F.lit("2024-13-45")).otherwise(F.col("shipping_date")),
    }).write.option("header", True).csv(path)
    return path


def ingest_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.read_checked(spark, _csv_orders(spark, sf_dir), SPECS["orders"])[0]


def ingest_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that does not parse; the names of part files differ from run to run and are left out."""
    return reader.read_checked(spark, _csv_orders(spark, sf_dir), SPECS["orders"])[1].drop("file")


def refresh_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh from exported files does: a first load, then one from a later export in which a table is missing."""
    tables, root = star_tables(spark, sf_dir), new_folder(spark, "refresh")
    chosen = {n: STAR_SPECS[n] for n in ("suppliers", "customers", "orders", "products")}
    orders = tables["orders"]
    late = F.col("order_date") > F.lit("1998-06-30").cast("date")
    early = F.col("order_date") < F.lit("1993-01-01").cast("date")
    for number, kept in enumerate((orders.where(~late), orders.where(~early))):
        for name in chosen:
            if (number, name) != (1, "products"):
                df = kept if name == "orders" else tables[name]
                df.write.option("header", True).csv(reader.source_path(f"{root}/export{number}", name, "csv"))
    flat = {n: replace(spec, partition_by=()) for n, spec in chosen.items()}  # a directory per day is many on small data
    sync_all(spark, f"{root}/export0", f"{root}/v0", f"{root}/v1", specs=flat, first_load=True)
    return sync_all(spark, f"{root}/export1", f"{root}/v1", f"{root}/v2", specs=flat)


def exported_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ABC report per product as people get it: headings, percent texts, one CSV folder, read back as text."""
    report = abc.abc_report(star_tables(spark, sf_dir), grain="product")
    path = writer.export_report(abc.abc_report_text(report), new_folder(spark, "reports"), "abc_analysis")
    return spark.read.option("header", True).csv(path)


def appended_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per month of a stored table that was written, replaced and appended to."""
    orders, path = star_tables(spark, sf_dir)["orders"], new_folder(spark, "orders")
    old = F.col("order_date") < F.lit("1996-01-01").cast("date")
    writer.write_table(orders, path)
    writer.write_table(orders.where(old), path)
    writer.append_table(orders.where(~old), path)
    return spark.read.parquet(path).groupBy(F.trunc("order_date", "month").alias("order_month")).agg(
        F.count(F.lit(1)).alias("n"))


def write_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT NULL rules and row counts gathered while tables are written."""
    tables, folder = star_tables(spark, sf_dir), new_folder(spark, "checked")
    unnamed = tables["customers"].withColumn(
        "customer_name", F.when(F.col("customer_id") % 10 != 3, F.col("customer_name")))
    found = writer.write_counted(unnamed, f"{folder}/customers", STAR_SPECS["customers"])
    return found.unionByName(writer.write_counted(tables["products"], f"{folder}/products", STAR_SPECS["products"]))


def lead_time_with_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead time of shipments whose dates have a time of day."""
    tables = star_tables(spark, sf_dir)
    hour = {"order_date": F.col("order_id") % 24, "shipping_date": F.col("order_id") * 7 % 24}
    timed = tables["orders"].withColumns({
        c: F.col(c).cast("timestamp_ntz") + F.make_dt_interval(hours=h.cast("int")) for c, h in hour.items()})
    return lead_time.lead_time(dict(tables) | {"orders": timed}, CUSTOMER).select(
        "order_id", "lead_time_days", "cycle_lead_time")


def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and last change of the given files, as shown on screen; no SQL knows files."""
    return catalog.source_inventory_text(catalog.source_inventory(spark, sf_dir, routes=STAR_ROUTES))


def queries(orders_snapshots) -> dict[str, Query]:
    """``orders_snapshots`` makes the stored and the exported orders of the sync queries."""
    return {
        "abc_report_stored": _from_stored(abc.abc_report, *RANGE),
        "abc_report_product_stored": _from_stored(abc.abc_report, grain="product"),
        "abc_summary_stored": _from_stored(_abc_summary, *RANGE),
        "abc_distribution_stored": _from_stored(abc.abc_distribution),
        "abc_top_product_stored": _from_stored(abc.abc_top_product),
        "snapshot_sync_buckets": lambda spark, sf_dir: bucket_synced(
            spark, *orders_snapshots(star_tables(spark, sf_dir))),
        "stored_row_counts": stored_row_counts,
        "stored_date_bounds": stored_date_bounds,
        "stock_status_choices": stock_status_choices,
        "stock_totals_choices": stock_totals_choices,
        "ingest_accepted": ingest_accepted,
        "ingest_rejected": ingest_rejected,
        "refresh_from_files": refresh_from_files,
        "report_export": exported_report,
        "appended_orders": appended_orders,
        "write_checks": write_checks,
        "lead_time_with_hours": lead_time_with_hours,
        "lead_time_text": lambda spark, sf_dir: lead_time.lead_time_avg_text(
            lead_time.lead_time_avg(star_tables(spark, sf_dir), SUPPLIER)),
        "source_inventory": source_inventory,
    }
