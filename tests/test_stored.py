"""Stored sales, bucketed versions, footers, choices from tables, checked ingest and checked writes."""

import re

import pytest
from pyspark.sql import functions as F

import stored_queries
from depotlens.functions.filters import ALL_DATES
from depotlens.operators import bucket_sync
from depotlens.operators.sync import keep_first, snapshot_sync
from depotlens.plans import abc, fill, sales_store, stock
from depotlens.session import SCAN_BYTES, SHUFFLE_PARTITIONS, SHUFFLED_BYTES
from depotlens.sources import footers, reader, writer
from depotlens.sources.schemas import SPECS
from depotlens.sources.star_schema import STAR_SPECS
from tests.helpers import D, make_tables, most_tasks, product, rows, warehouse
from tests.helpers import stock as stock_row
from tests.test_plans import final_plan, initial_plan


def order(number, day, *lines):
    return ({"order_id": number, "order_date": day},
            [{"order_id": number, "product_code": code, "quantity": n} for code, n in lines])


def sales(spark, *orders):
    heads, lines = zip(*orders) if orders else ((), ())
    return make_tables(spark, products=[product(c, f"p{c}") for c in (1, 2, 3)], orders=list(heads),
                       order_details=[x for own in lines for x in own])


# stored sales ---------------------------------------------------------------------------------------

JAN, FEB, MAR = D(2024, 1, 5), D(2024, 2, 6), D(2024, 3, 7)


def contents(spark, path):
    return sorted(rows(sales_store.stored_sales(spark, path).select("order_date", "product_code", "quantity", "line_count")))


def test_refresh_replaces_only_the_months_that_changed(spark, tmp_path):
    path = str(tmp_path / "sales")
    before = sales(spark, order(1, JAN, (1, 5), (1, 2), (2, 1)), order(2, FEB, (2, 4)), order(3, MAR, (3, 3)))
    after = sales(spark, order(1, JAN, (1, 5), (1, 2), (2, 1)), order(2, FEB, (2, 9)), order(4, D(2024, 4, 1), (1, 1)))
    sales_store.refresh_sales(before, path)
    assert contents(spark, path) == [(JAN, 1, 7, 2), (JAN, 2, 1, 1), (FEB, 2, 4, 1), (MAR, 3, 3, 1)]
    january = sorted((tmp_path / "sales").glob("order_month=2024-01-01/*.parquet"))
    changed = sales_store.changed_dates(before, after)
    assert sorted(rows(changed)) == [(FEB,), (MAR,), (D(2024, 4, 1),)]
    sales_store.refresh_sales(after, path, changed)
    # march lost all it had
    assert contents(spark, path) == [(JAN, 1, 7, 2), (JAN, 2, 1, 1), (FEB, 2, 9, 1), (D(2024, 4, 1), 1, 1, 1)]
    assert sorted((tmp_path / "sales").glob("order_month=2024-01-01/*.parquet")) == january
    assert rows(sales_store.changed_dates(after, after)) == []


def test_changes_of_every_kind_mark_their_dates(spark):
    before = sales(spark, order(1, JAN, (1, 5)), order(2, FEB, (1, 5)), order(3, MAR, (1, 5), (2, None)))
    moved = sales(spark, order(1, D(2024, 1, 6), (1, 5)), order(2, FEB, (1, 5), (1, 5)), order(3, MAR, (2, None), (1, 5)))
    assert sorted(rows(sales_store.changed_dates(before, moved))) == [(JAN,), (D(2024, 1, 6),), (FEB,)]
    undated = sales(spark, order(1, JAN, (1, 5)), order(2, FEB, (1, 5)), order(3, None, (1, 5), (2, None)))
    assert rows(sales_store.changed_dates(before, undated)) == [(MAR,)]


def test_stored_sales_of_nothing(spark, tmp_path):
    path = str(tmp_path / "sales")
    empty = sales(spark)
    sales_store.refresh_sales(empty, path)
    assert rows(abc.abc_report(empty, stored=path)) == []
    assert rows(abc.abc_summary(empty, stored=path)) == [(0, 0, 0, 0, 0)]


@pytest.mark.parametrize("span", [(None, None), (JAN, FEB), (D(2024, 1, 6), None), (None, FEB), (MAR, MAR)])
def test_reports_from_stored_sales_are_the_same(spark, tmp_path, span):
    path = str(tmp_path / "sales")
    tables = sales(spark, order(1, JAN, (1, 5), (1, 2), (2, None), (9, 4)), order(2, FEB, (2, 4), (3, 1)),
                   order(3, MAR, (3, 3), (3, -5)), order(4, None, (1, 100)))
    sales_store.refresh_sales(tables, path)
    for job in (abc.abc_report, abc.abc_summary, abc.abc_distribution, abc.abc_top_product):
        assert rows(job(tables, *span, stored=path)) == rows(job(tables, *span))


def test_stored_reports_read_no_order_and_only_their_months(spark, star, tmp_path):
    path = stored_queries.refreshed_sales(spark, star)
    for job in (abc.abc_report, abc.abc_summary, abc.abc_distribution, abc.abc_top_product):
        plan = initial_plan(job(star, D(1996, 2, 3), D(1996, 5, 20), stored=path))
        assert "lineitem" not in plan and "o_orderkey" not in plan
        assert re.search(r"PartitionFilters: [^\n]*order_month#\d+ >= 1996-02-01", plan)
    read = sales_store.stored_sales(spark, path, D(1996, 2, 3), D(1996, 5, 20)).inputFiles()
    assert {m for f in read for m in re.findall(r"order_month=([\d-]+)", f)} >= {"1996-02-01", "1996-05-01"}
    assert rows(abc.abc_summary(star, stored=path)) == rows(abc.abc_summary(star))


# first rows -----------------------------------------------------------------------------------------

def test_unique_rows_are_not_ordered(spark):
    df = spark.range(1000).select((F.col("id") % 990).alias("key"), F.concat(F.lit("t"), "id").alias("text"))
    first = keep_first(df, ["key"])
    plan = initial_plan(first)
    assert sorted(rows(first)) == sorted((k, min(f"t{i}" for i in range(k, 1000, 990))) for k in range(990))
    assert "LeftAnti" in plan and "LeftSemi" in plan
    # only rows that come out of the semi join are ordered
    assert plan.count("SortAggregate") == 2
    assert plan.index("LeftAnti") < plan.index("SortAggregate") and plan.rindex("SortAggregate") < plan.index("LeftSemi")
    unique = df.where("key >= 10")
    assert "Aggregate" not in initial_plan(keep_first(unique, ["key"]))


@pytest.mark.parametrize("most", [0, 1, 1000])
def test_first_rows_whatever_the_number_of_repeated_keys(spark, most):
    data = [(1, 2, "b"), (1, 2, "a"), (1, None, "c"), (1, None, None), (None, None, "z"), (None, None, "y"), (2, 2, "q")]
    df = spark.createDataFrame(data, "a int, b int, t string")
    assert sorted(rows(keep_first(df, ["a", "b"], most_keys=most)), key=str) == sorted(
        [(1, 2, "a"), (1, None, None), (None, None, "y"), (2, 2, "q")], key=str)
    longest = spark.createDataFrame([(1, "a"), (1, "ccc"), (1, "bb"), (2, "x")], "a int, t string")
    assert sorted(rows(keep_first(longest, ["a"], [-F.length("t")], most_keys=most))) == [(1, "ccc"), (2, "x")]


# versions by bucket ---------------------------------------------------------------------------------

KEY, SCHEMA = ["id"], "id BIGINT, name STRING"


def numbered(spark, ids, text="stored"):
    return spark.createDataFrame([(i, f"{text}{k}") for k, i in enumerate(ids)], SCHEMA)


@pytest.mark.parametrize("case", ["same", "gone and new", "copies", "null", "empty source", "empty target"])
def test_bucket_sync_equals_sync(spark, tmp_path, case):
    have, want = list(range(40)), list(range(40))
    have, want = {
        "same": (have, want), "gone and new": (have, want[:-3] + [77, 90, 90]), "copies": (have + [5, 5], want),
        "null": (have + [None], want + [None]), "empty source": (have, []), "empty target": ([], want)}[case]
    target, source = numbered(spark, have), numbered(spark, want, "exported")
    one, two, three = (str(tmp_path / v) for v in ("v1", "v2", "v3"))
    bucket_sync.store_version(target, one, KEY, 4)
    stale = bucket_sync.sync_version(spark, one, source, two, KEY)
    expected = sorted(rows(snapshot_sync(target, source, KEY)), key=str)
    assert sorted(rows(bucket_sync.read_version(spark, two)), key=str) == expected
    assert (stale == []) == (case == "same")
    if case == "gone and new":  # its new copies are reduced by the next run
        bucket_sync.sync_version(spark, two, source, three, KEY)
        again = sorted(rows(snapshot_sync(bucket_sync.read_version(spark, two), source, KEY)), key=str)
        assert sorted(rows(bucket_sync.read_version(spark, three)), key=str) == again


def test_one_bucket_is_read_and_written(spark, tmp_path):
    one, two = str(tmp_path / "v1"), str(tmp_path / "v2")
    bucket_sync.store_version(numbered(spark, range(200)), one, KEY, 8)
    source = numbered(spark, range(199), "exported")
    stale = bucket_sync.sync_version(spark, one, source, two, KEY)
    assert len(stale) == 1
    written = {m for p in (tmp_path / "v2").rglob("*.parquet") for m in re.findall(r"_bucket=(\d+)", str(p))}
    assert written == {str(stale[0])}
    held = {e.bucket: e.folder for e in bucket_sync._entries(spark, two)}
    assert {b for b, f in held.items() if f.startswith(two)} == set(stale)
    mine = bucket_sync._read(spark, [e for e in bucket_sync._entries(spark, one) if e.bucket in stale],
                             numbered(spark, [1]).schema)
    assert {m for f in mine.inputFiles() for m in re.findall(r"_bucket=(\d+)", f)} >= {str(stale[0])}
    assert re.search(r"PartitionFilters: [^\n]*_bucket", initial_plan(mine))


def test_unfinished_versions_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        bucket_sync.sync_version(spark, str(tmp_path / "none"), numbered(spark, [1]), str(tmp_path / "next"), KEY)
    bucket_sync.store_version(numbered(spark, [1]), str(tmp_path / "v1"), KEY, 2)
    with pytest.raises(ValueError):
        bucket_sync.sync_version(spark, str(tmp_path / "v1"), numbered(spark, [1]), str(tmp_path / "v1/"), KEY)


# footers --------------------------------------------------------------------------------------------

def test_counts_and_bounds_come_from_footers(spark, star, small, tmp_path):
    path = str(tmp_path / "orders")
    writer.write_table(star["orders"], path)
    bounds = footers.column_bounds(spark, path, "order_date")
    plan = initial_plan(bounds)
    assert re.search(r"PushedAggregation: \[MIN\(order_date\), MAX\(order_date\)\]", plan), plan
    assert rows(bounds) == rows(star["orders"].agg(F.min("order_date"), F.max("order_date")))
    counts = footers.row_counts(spark, {"lineitem": f"{small}/lineitem.parquet"})
    assert "PushedAggregation: [COUNT(*)]" in initial_plan(counts)
    assert rows(counts) == [("lineitem", spark.read.parquet(f"{small}/lineitem.parquet").count())]
    # tables that are opened otherwise keep their reader
    assert "BatchScan" not in initial_plan(spark.read.parquet(path))


def test_bounds_of_a_partition_column(spark, star, tmp_path):
    path = str(tmp_path / "stock")
    writer.write_table(star["warehouse_stock"], path, ("stock_date",))
    spark.range(0).selectExpr("1L AS product_code", "1 AS warehouse_id").write.parquet(f"{path}/stock_date=2050-01-01")
    bounds = footers.column_bounds(spark, path, "stock_date", ("stock_date",))
    assert "PushedAggregation: [COUNT(*)]" in initial_plan(bounds)
    assert rows(bounds) == rows(star["warehouse_stock"].agg(F.min("stock_date"), F.max("stock_date")))


# choices from tables --------------------------------------------------------------------------------

def test_choices_from_a_table_prune_directories(spark, star, tmp_path):
    path = str(tmp_path / "stock")
    writer.write_table(star["warehouse_stock"], path, ("stock_date",))
    tables = dict(star) | {"warehouse_stock": spark.read.parquet(path)}
    months = star["orders"].where("order_id < 40").select(F.trunc("order_date", "month"))
    status = stock.stock_status(tables, months)
    plan = final_plan(status)
    assert "dynamicpruningexpression" in plan
    listed = [r[0] for r in months.distinct().collect()]
    assert sorted(rows(status), key=str) == sorted(rows(stock.stock_status(star, listed)), key=str)


def test_choices_from_tables_equal_lists(spark):
    tables = make_tables(
        spark, products=[product(1, "ring", 5, 1)], warehouses=[warehouse(1, "a", 100), warehouse(2, "b", 100)],
        warehouse_stock=[stock_row(JAN, 1, 1, 3), stock_row(JAN, 1, 2, 4), stock_row(FEB, 1, 1, 5)])
    days = spark.createDataFrame([(JAN,), (JAN,), (MAR,), (None,)], "d date")
    names = spark.createDataFrame([("a",), ("a",), ("unknown",), (None,)], "n string")
    none = names.limit(0)
    assert rows(stock.stock_status(tables, days, names)) == [(JAN, "ring", "a", 3)]
    assert sorted(rows(stock.stock_totals_by_date(tables, days, names))) == [(JAN, 3), (MAR, 0)]
    assert rows(stock.stock_trend(tables, days, names)) == [(JAN, "a", 3)]
    assert rows(fill.fill_levels(tables, None, names)) == rows(fill.fill_levels(tables, None, ["a"]))
    assert rows(stock.stock_status(tables, ALL_DATES, none)) == []


def test_trend_reads_the_stock_once(spark, tmp_path, star):
    path = str(tmp_path / "stock")
    writer.write_table(star["warehouse_stock"], path)
    tables = dict(star) | {"warehouse_stock": spark.read.parquet(path)}
    plan = final_plan(stock.stock_trend(tables, ALL_DATES, term="ring"))
    assert len(re.findall(r"FileScan parquet [^\n]*quantity_available", plan)) <= 2
    assert "ReusedExchange" in plan or len(re.findall(r"FileScan parquet [^\n]*quantity_available", plan)) == 1


# ingest and writes ----------------------------------------------------------------------------------

def test_rows_that_do_not_parse_are_kept_aside(spark, tmp_path):
    folder = tmp_path / "suppliers.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("supplier_id,supplier_name\n1,one\nx2,two\n,three\n")
    (folder / "b.csv").write_text("supplier_id,supplier_name\n9999999999999999999999,big\n4,\n")
    accepted, rejected = reader.read_checked(spark, str(folder), SPECS["suppliers"])
    assert sorted(rows(accepted), key=str) == [(1, "one"), (4, None), (None, "three")]
    assert sorted(rows(rejected)) == [
        ("suppliers", "a.csv", "x2", "supplier_id", "x2"),
        ("suppliers", "b.csv", "9999999999999999999999", "supplier_id", "9999999999999999999999")]
    assert "Exchange" not in initial_plan(rejected)
    assert reader.read_checked(spark, str(tmp_path / "absent.csv"), SPECS["suppliers"]) is None
    (tmp_path / "odd.csv").write_text("supplier_id,name\n1,one\n")
    with pytest.raises(ValueError):
        reader.read_checked(spark, str(tmp_path / "odd.csv"), SPECS["suppliers"])


def test_checks_are_gathered_while_writing(spark, tmp_path):
    tables = make_tables(spark, products=[product(1, "p"), product(None, None), product(2, None)])
    found = writer.write_counted(tables["products"], str(tmp_path / "products"), SPECS["products"])
    assert sorted(rows(found)) == [("products", "not_null", "product_code", 1), ("products", "not_null", "product_name", 2),
                                   ("products", "row_count", "", 3)]
    assert spark.read.parquet(str(tmp_path / "products")).count() == 3


def test_tables_by_date_and_bucket_join_in_place(spark, star, tmp_path):
    spark.sql(f"CREATE DATABASE both LOCATION '{tmp_path}/both'")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    months = star["orders"].withColumn("order_date", F.trunc("order_date", "month"))
    try:
        writer.save_table(months, "both.orders", SPECS["orders"], 4, by_date=True)
        numbered_lines = star["order_details"].selectExpr("order_id * 100 AS order_product_id", "*")
        writer.save_table(numbered_lines, "both.order_details", SPECS["order_details"], 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tables = reader.catalog_tables(spark, "both.")
        some = tables["orders"].where((F.col("order_date") >= F.lit(D(1996, 1, 1))) & (F.col("order_date") < F.lit(D(1996, 4, 1))))
        joined = tables["order_details"].join(some.select("order_id"), "order_id")
        plan = initial_plan(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert re.search(r"PartitionFilters: \[[^\n]*order_date", plan)
        expected = star["order_details"].join(
            months.where("order_date >= '1996-01-01' and order_date < '1996-04-01'").select("order_id"), "order_id")
        assert joined.count() == expected.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP DATABASE both CASCADE")


def test_delivery_ids_of_many_suppliers_differ(spark, tmp_path):
    from depotlens.sources.star_schema import star_tables

    spark.createDataFrame([(1, 200_000, 1, 5.0), (2, 100_000, 1, 5.0), (3, 0, 1, 5.0)],
                          "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, D(2024, 1, 1)) for i in (1, 2, 3)], "o_orderkey long, o_orderdate date").write.parquet(
        str(tmp_path / "orders.parquet"))
    tables = star_tables(spark, str(tmp_path))
    assert sorted(r[0] for r in rows(tables["deliveries"].select("delivery_id"))) == ["1-200000", "2-100000", "3-0"]
    assert tables["deliveries"].dtypes == spark.createDataFrame([], STAR_SPECS["deliveries"].schema).dtypes
    assert tables["delivery_details"].select("delivery_id").distinct().count() == 3


def test_a_bucket_of_many_rows_is_synchronised_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bucket_sync, "ROWS_PER_PARTITION", 1000)
    before = {c: spark.conf.get(c, None) for c in (SHUFFLE_PARTITIONS, SHUFFLED_BYTES, SCAN_BYTES)}
    target = spark.range(20_000).select(F.col("id").alias("id"), F.lit("old").alias("v"))
    source = spark.range(10_000, 30_000).select(F.col("id").alias("id"), F.lit("new").alias("v"))
    one, two = str(tmp_path / "v1"), str(tmp_path / "v2")
    bucket_sync.store_version(target, one, KEY, 1, task_bytes=4096)
    most = most_tasks(spark, lambda: bucket_sync.sync_version(spark, one, source, two, KEY, task_bytes=4096))
    assert most > int(before[SHUFFLE_PARTITIONS])
    found = bucket_sync.read_version(spark, two).groupBy("v").agg(F.min("id"), F.max("id"), F.count("id"))
    assert sorted(rows(found)) == [("new", 20_000, 29_999, 10_000), ("old", 10_000, 19_999, 10_000)]
    assert {c: spark.conf.get(c, None) for c in before} == before
