"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from depotlens.functions.filters import ALL_DATES
from depotlens.operators.sync import keep_first
from depotlens.plans import abc, fill, lead_time, shortages, stock, timeliness
from depotlens.plans.party import CUSTOMER, SUPPLIER
from depotlens.sources.reader import read_tables, source_path
from depotlens.sources.schemas import SPECS
from depotlens.sources.writer import write_table
from tests.helpers import D, make_tables, product, rows, warehouse

SMALL = "/root/testdata/sf0.001"


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan adaptive execution ended with, without the one it began with."""
    df.collect()
    kept, skip_at = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(re.match(r"[\s:+|-]*", line).group())
        if skip_at is not None and depth >= skip_at:
            continue
        skip_at = depth if "== Initial Plan ==" in line else None
        if skip_at is None:
            kept.append(line)
    return "\n".join(kept)


@pytest.fixture(scope="module")
def stored(spark, star, tmp_path_factory):
    """The tables as files in their stored layout."""
    root = str(tmp_path_factory.mktemp("stored"))
    ids = {"warehouse_stock": "stock_id", "order_details": "order_product_id",
           "delivery_details": "delivery_detail_id"}
    for name, spec in SPECS.items():
        df = star[name]
        if name in ids:
            df = df.withColumn(ids[name], F.lit(1).cast("bigint"))
        # one directory per month and not per day: these tables are tiny
        partition_by = spec.partition_by if name == "warehouse_stock" else ()
        write_table(df, source_path(root, name, "parquet"), partition_by)
    return read_tables(spark, root)


@pytest.mark.parametrize("name", sorted(contract.report_queries()))
def test_no_python_and_no_cross_join(spark, name):
    plan = initial_plan(contract.report_queries()[name](spark, SMALL))
    for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
    # rows are only limited to ask whether there are any
    assert "Limit" not in plan or name in ("stock_trend", "stock_trend_filtered")
    # the only unpartitioned window is the one over at most 256 range sums
    for window in re.findall(r"Window .*", plan):
        assert "_range" in window


def test_date_filter_prunes_stock_partitions(stored):
    plan = initial_plan(stock.stock_status(stored, [D(1998, 3, 1)]))
    assert re.search(r"PartitionFilters: \[[^\]]*stock_date", plan)


def test_latest_date_prunes_stock_partitions(stored):
    plan = initial_plan(fill.fill_levels(stored))
    assert re.search(r"PartitionFilters: \[[^\]]*stock_date[^\]]*Subquery", plan)


def test_scans_read_only_needed_columns(stored):
    plan = initial_plan(stock.stock_trend(stored, ALL_DATES))
    assert "ReadSchema: struct<warehouse_id:int,quantity_available:bigint>" in plan
    plan = initial_plan(timeliness.on_time(stored, SUPPLIER))
    assert "ReadSchema: struct<supplier_id:bigint,order_date:date,delivery_status:string>" in plan


def test_filters_are_pushed_below_joins(stored):
    plan = initial_plan(timeliness.timeliness(stored, CUSTOMER, D(1998, 1, 1), D(1998, 12, 31), ["In progress"]))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(order_date,1998-01-01\)", plan)
    assert re.search(r"PushedFilters: [^\n]*\((shipping_status, ?\[?In progress)", plan)
    plan = initial_plan(abc.product_sales(stored, D(1998, 1, 1)))
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(order_date,1998-01-01\)", plan)


@pytest.mark.parametrize("job", [abc.abc_report, abc.abc_summary, abc.abc_distribution])
def test_ranking_reads_the_lines_once(stored, job):
    plan = final_plan(job(stored))
    assert len(re.findall(r"FileScan parquet [^\n]*order_details", plan)) == 1
    assert "ReusedExchange" in plan
    # the bounds are searched once for the range sums and once for the ranking
    assert len(re.findall(r"Filter [^\n]*lambdafunction", plan)) == 0


def test_sums_by_date_read_the_stock_once(stored):
    for df in (stock.stock_totals_by_date(stored, ALL_DATES), stock.stock_totals_by_date(stored, [D(1998, 3, 1)]),
               shortages.shortage_bars(stored, ALL_DATES)):
        assert len(re.findall(r"FileScan parquet [^\n]*warehouse_stock", final_plan(df))) == 1


def test_one_shuffle_per_partner_metric(stored):
    """Partial sums per partner travel once, one row travels for the total."""
    for df in (timeliness.on_time(stored, SUPPLIER), lead_time.lead_time_avg(stored, CUSTOMER)):
        exchanges = re.findall(r"Exchange (hashpartitioning|SinglePartition)", final_plan(df))
        assert sorted(exchanges) == ["SinglePartition", "hashpartitioning"]


def skewed_lines(spark):
    """One order and one product hold a third of all lines."""
    lines = spark.range(0, 300_000, 1, 8).select(
        F.col("id").alias("order_product_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).alias("order_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("product_code"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("quantity"))
    orders = spark.range(5000).select(
        F.col("id").alias("order_id"), F.lit(1).cast("bigint").alias("customer_id"),
        F.lit(D(2024, 1, 1)).alias("order_date"))
    return lines, orders


def test_hot_order_is_split(spark):
    lines, orders = skewed_lines(spark)
    tables = dict(make_tables(spark, products=[product(i, f"p{i}") for i in range(40)]))
    tables |= {"order_details": lines, "orders": orders}
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sales = abc.product_sales(tables)
        plan = final_plan(sales)
        got = {r[0]: r[1:] for r in rows(sales)}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    expected = lines.groupBy("product_code").agg(F.sum("quantity"), F.count("*"))
    assert got == {f"p{r[0]}": tuple(r[1:]) for r in rows(expected)}


def test_listing_is_even_with_hot_and_rare_products(spark):
    hot, rare, many = 20, 20_000, 10_000
    lines = spark.range(hot * many + rare * 2).select(
        F.col("id").alias("order_product_id"), F.lit(1).cast("bigint").alias("order_id"),
        F.expr(f"if(id < {hot * many}, id % {hot}, {hot} + id % {rare})").alias("product_code"),
        F.lit(1).cast("bigint").alias("quantity"))
    orders = spark.range(2).select(
        F.col("id").alias("order_id"), F.lit(1).cast("bigint").alias("customer_id"), F.lit(D(2024, 1, 1)).alias("order_date"))
    names = spark.range(hot + rare).select(F.col("id").alias("product_code"), F.concat(F.lit("p"), "id").alias("product_name"))
    tables = dict(make_tables(spark)) | {"order_details": lines, "orders": orders, "products": names}
    report = abc.abc_report(tables)
    got = rows(report.groupBy(F.spark_partition_id()).agg(F.count("*"), F.min("total_sales"), F.max("total_sales")))
    assert sum(r[1] for r in got) == hot * many + rare * 2
    assert max(r[1] for r in got) <= 2 * sum(r[1] for r in got) / len(got) and len(got) > 1
    in_order = sorted(got)
    assert all(x[2] >= y[3] for x, y in zip(in_order, in_order[1:])), "largest first over the tasks"


def test_copies_of_one_key_are_reduced_before_the_shuffle(spark):
    copies = spark.range(0, 100_000, 1, 4).select(F.lit(1).alias("key"), F.col("id").alias("value"))
    first = keep_first(copies, ["key"])
    assert rows(first) == [(1, 0)]
    plan = initial_plan(first)
    assert "partial_min" in plan and "Window" not in plan


def test_warehouse_join_sees_sums_only(stored):
    plan = initial_plan(stock.stock_trend(stored, ALL_DATES))
    join = plan.index("Join")
    assert plan.index("partial_sum", join) > join, "stock is summed below the join"


def test_empty_tables_give_empty_reports(spark):
    empty = make_tables(spark, warehouses=[warehouse(1, "w", 1)])
    for df in (fill.fill_levels(empty), stock.stock_status(empty), stock.stock_trend(empty),
               shortages.shortages(empty), shortages.shortage_bars(empty), abc.abc_report(empty),
               timeliness.timeliness(empty, SUPPLIER), lead_time.speed(empty, CUSTOMER)):
        assert rows(df) == []
