import re

import pytest

from depotlens.plans import abc, timeliness
from depotlens.plans.party import SUPPLIER
from depotlens.sources import catalog, writer
from depotlens.sources.reader import catalog_tables
from depotlens.sources.schemas import SPECS
from tests.helpers import make_tables, product, rows, sales_tables


def test_catalog_lists_registered_tables(spark, star):
    catalog.register_views(star, "listed_")
    assert {r[0] for r in rows(catalog.table_catalog(spark, "listed_"))} == {"listed_" + n for n in SPECS}
    counts = dict(rows(catalog.row_counts(make_tables(spark, products=[product(1, "p")]), "x_")))
    assert counts == {"x_" + n: int(n == "products") for n in SPECS}


def test_sql_with_bound_values(spark, star):
    df = catalog.query(spark, star, "SELECT COUNT(*) FROM {suppliers} WHERE supplier_name <> :name",
                       {"name": "' OR 1=1 --"})
    assert rows(df) == [(star["suppliers"].count(),)]


def test_browse(star):
    assert catalog.browse_table(star, "products").count() == star["products"].count()
    assert catalog.browse_table(star, "products", limit=3).count() == 3
    with pytest.raises(ValueError):
        catalog.browse_table(star, "nothing")


def test_source_inventory_adds_up_part_files(spark, tmp_path):
    (tmp_path / "orders.csv").write_bytes(b"x" * 1048576)
    (tmp_path / "products.csv").mkdir()
    for part in ("part-0.csv", "part-1.csv"):
        (tmp_path / "products.csv" / part).write_bytes(b"x" * 262144)
    (tmp_path / "other.csv").write_bytes(b"x")
    (tmp_path / "customers.parquet").write_bytes(b"x")
    got = {r[0]: r[1:] for r in rows(catalog.source_inventory(spark, str(tmp_path), "csv"))}
    assert {name: size for name, (size, _) in got.items()} == {"orders": 1.0, "products": 0.5}
    shown = catalog.source_inventory_text(catalog.source_inventory(spark, str(tmp_path), "csv"))
    assert {r[1] for r in rows(shown)} == {"1.00 MB", "0.50 MB"}
    absent = catalog.source_inventory(spark, str(tmp_path / "absent"), "csv")
    assert rows(absent) == [] and absent.columns == shown.columns
    assert all(re.fullmatch(r"\d\d-\d\d-\d{4} \d\d:\d\d:\d\d", modified) for _, modified in got.values())


def test_source_inventory_reads_no_content(spark, tmp_path):
    (tmp_path / "orders.csv").write_bytes(b"x")
    plan = catalog.source_inventory(spark, str(tmp_path), "csv")._jdf.queryExecution().toString()
    assert "content" not in plan.split("== Physical Plan ==")[1]


def test_report_export(spark, tmp_path):
    tables = sales_tables(spark, [("a", 3), ("b", 1)])
    report = abc.abc_report(tables)
    path = writer.export_report(abc.abc_report_text(report), str(tmp_path), "abc_analysis")
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["Product Name", "Total Sales", "Sales Percentage", "Cumulative Percentage", "ABC Category"]
    assert sorted(rows(back)) == [("a", "3", "75.0%", "75.0%", "C"), ("b", "1", "25.0%", "100.0%", "C")]
    path = writer.export_report(report, str(tmp_path), "abc_analysis", "parquet")
    assert spark.read.parquet(path).columns == report.columns
    for name, fmt in (("unknown", "csv"), ("abc_analysis", "xls")):
        with pytest.raises(ValueError):
            writer.export_report(report, str(tmp_path), name, fmt)


def test_export_headings(star):
    assert writer.with_headings(timeliness.timeliness(star, SUPPLIER)).columns == [
        "Delivery Number", "Supplier Name", "Order Date", "Expected Delivery Date", "Delivery Date", "Delivery Status"]


def test_bucketed_tables_join_without_a_shuffle(spark, star, tmp_path):
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path}/bucketed'")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        orders, details = SPECS["orders"], SPECS["order_details"]
        writer.save_table(star["orders"], "bucketed.orders", orders, 4)
        numbered = star["order_details"].selectExpr("order_id * 100 AS order_product_id", "*")
        writer.save_table(numbered, "bucketed.order_details", details, 4)
        writer.save_table(star["products"], "bucketed.products", SPECS["products"], 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        saved = catalog_tables(spark, "bucketed.")
        joined = saved["order_details"].join(saved["orders"].select("order_id"), "order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert rows(abc.abc_top_product(saved)) == rows(abc.abc_top_product(star))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP DATABASE bucketed CASCADE")
