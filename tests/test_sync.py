import pytest
from pyspark.sql import functions as F

from depotlens.operators import sync
from depotlens.operators.integrity import integrity_checks
from depotlens.session import SHUFFLE_PARTITIONS, SHUFFLED_BYTES
from depotlens.sources import writer
from depotlens.sources.reader import conform, read_snapshot, read_tables, source_path
from depotlens.sources.schemas import SPECS, TableSpec
from depotlens.sources.star_schema import STAR_SPECS
from tests.helpers import D, make_tables, most_tasks, product, rows, stock

SCHEMA = "id BIGINT, name STRING, n INT"
KEY = ["id"]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "b", 1), (1, "a", 9), (2, "x", 2), (3, "gone", 3), (3, "gone", 4)], SCHEMA)


@pytest.fixture(scope="module")
def source(spark):
    return spark.createDataFrame([(1, "new", 0), (2, "x", 7), (5, "five", 5), (5, "again", 6), (6, None, None)], SCHEMA)


def test_sync_keeps_adds_and_deletes(target, source):
    assert sorted(rows(sync.snapshot_sync(target, source, KEY)), key=str) == [
        (1, "a", 9), (2, "x", 2), (5, "again", 6), (5, "five", 5), (6, None, None)]


def test_sync_counts(target, source):
    assert rows(sync.sync_summary(target, source, KEY, "t")) == [("t", 2, 3, 2, "synced")]
    assert rows(sync.sync_summary(target, None, KEY, "t")) == [("t", 0, 0, 0, "skipped")]
    nothing = target.where(F.lit(False))
    assert rows(sync.sync_summary(nothing, nothing, KEY, "t")) == [("t", 0, 0, 0, "synced")]


def test_first_load_only_adds(target, source):
    assert sorted(rows(sync.insert_missing(target, source, KEY)), key=str) == [
        (1, "a", 9), (1, "b", 1), (2, "x", 2), (3, "gone", 3), (3, "gone", 4), (5, "again", 6), (5, "five", 5),
        (6, None, None)]


def test_first_copy_follows_the_given_order(target):
    first = sync.keep_first(target, KEY, [-F.col("n")])
    assert sorted(rows(first)) == [(1, "a", 9), (2, "x", 2), (3, "gone", 4)]
    assert sorted(rows(sync.keep_first(target, KEY))) == [(1, "a", 9), (2, "x", 2), (3, "gone", 3)]
    assert sorted(rows(sync.keep_first(target.select("id"), KEY))) == [(1,), (2,), (3,)]


def test_sync_twice_equals_once(star):
    orders = star["orders"]
    stored = orders.where(F.col("order_date") < F.lit(D(2000, 1, 1)))
    once = sync.snapshot_sync(stored, orders, ["order_id"])
    twice = sync.snapshot_sync(once, orders, ["order_id"])
    assert sorted(rows(once), key=str) == sorted(rows(twice), key=str)
    assert once.count() == orders.count()


def test_sync_of_all_tables(spark, tmp_path):
    version0, version1, version2, source = (str(tmp_path / d) for d in ("v0", "v1", "v2", "src"))
    exported = make_tables(
        spark,
        suppliers=[{"supplier_id": 1, "supplier_name": "s"}],
        products=[product(1, "p"), product(2, "q")],
        warehouse_stock=[{"stock_id": i, **stock(D(2024, 1, i), 1, 1, i)} for i in (1, 2)],
    )
    for name in ("suppliers", "products", "warehouse_stock"):
        exported[name].write.option("header", True).csv(source_path(source, name, "csv"))
    summary = {r[0]: r[1:] for r in rows(sync.sync_all(spark, source, version0, version1, first_load=True))}
    assert set(summary) == set(SPECS)
    assert summary["products"] == (0, 2, 0, "synced")
    assert summary["orders"] == (0, 0, 0, "skipped")
    stored = read_tables(spark, version1)
    assert sorted(rows(stored["warehouse_stock"]))[0] == (1, D(2024, 1, 1), 1, 1, None, None, 1)
    assert rows(stored["orders"]) == []

    again = {r[0]: r[1:] for r in rows(sync.sync_all(spark, source, version1, version2))}
    assert again["warehouse_stock"] == (0, 0, 0, "synced")
    assert sorted(rows(read_tables(spark, version2)["products"])) == sorted(rows(stored["products"]))
    with pytest.raises(ValueError):
        sync.sync_all(spark, source, version1, version1 + "/")
    with pytest.raises(ValueError):
        sync.sync_all(spark, source, version0, version2 + "x")

    # an upload in progress is no empty table
    (tmp_path / "uploading" / "products.csv" / "_temporary").mkdir(parents=True)
    third = {r[0]: r[1:] for r in rows(sync.sync_all(spark, str(tmp_path / "uploading"), version2, version2 + "y"))}
    assert third["products"] == (0, 0, 0, "skipped")
    assert read_tables(spark, version2 + "y")["products"].count() == stored["products"].count()


def test_csv_is_typed_and_malformed_text_becomes_null(spark, tmp_path):
    path = tmp_path / "deliveries.csv"
    path.write_text(
        "supplier_id,delivery_id,order_date,expected_delivery_date,delivery_date,delivery_status\n"
        "7,1,2024-02-01 00:00:00,2024-02-05,soon,In progress\n")
    df = read_snapshot(spark, str(path), SPECS["deliveries"], "csv")
    assert df.schema == SPECS["deliveries"].schema
    assert rows(df) == [(1, 7, D(2024, 2, 1), D(2024, 2, 5), None, "In progress")]
    assert read_snapshot(spark, str(tmp_path / "absent.csv"), SPECS["deliveries"], "csv") is None


def test_unexpected_headers_are_refused(spark):
    with pytest.raises(ValueError, match="supplier_name"):
        conform(spark.createDataFrame([(1, "x")], "supplier_id BIGINT, label STRING"), SPECS["suppliers"])


def test_append(spark, tmp_path, target):
    path = str(tmp_path / "t")
    writer.write_table(target, path)
    writer.append_table(target.limit(1), path)
    assert spark.read.parquet(path).count() == 6


def test_integrity(spark):
    tables = make_tables(
        spark,
        suppliers=[{"supplier_id": 1, "supplier_name": None}, {"supplier_id": 1, "supplier_name": "x"},
                   {"supplier_id": 1, "supplier_name": "y"}, {"supplier_id": None, "supplier_name": "z"},
                   {"supplier_id": None, "supplier_name": "z"}],
        deliveries=[{"delivery_id": i, "supplier_id": s} for i, s in enumerate((1, 8, 8, None))],
    )
    found = {r[:3]: r[3] for r in rows(integrity_checks(tables))}
    assert {k: v for k, v in found.items() if v} == {
        ("suppliers", "primary_key", "supplier_id"): 2,
        ("suppliers", "not_null", "supplier_id"): 2,
        ("suppliers", "not_null", "supplier_name"): 1,
        ("deliveries", "foreign_key", "supplier_id"): 2,
    }
    assert len(found) == 9 + 9 + 4 + 8  # keys, NULLs in keys, NULLs in names, references


def test_integrity_of_many_keys_is_checked_by_many_tasks(spark, tmp_path):
    before = spark.conf.get(SHUFFLED_BYTES, None)
    path = str(tmp_path / "deliveries")
    spark.range(30_000).selectExpr("cast(id % 29990 as string) as delivery_id", "id as supplier_id").coalesce(1).write.parquet(path)
    spec = TableSpec("deliveries", STAR_SPECS["deliveries"].schema, key=("delivery_id",))
    found, tables = [], {"deliveries": spark.read.parquet(path)}

    def run():
        found.extend(rows(integrity_checks(tables, {"deliveries": spec}, task_bytes=16384, partitions=64)))

    assert most_tasks(spark, run) > int(spark.conf.get(SHUFFLE_PARTITIONS))
    assert sorted(found) == [("deliveries", "not_null", "delivery_id", 0), ("deliveries", "primary_key", "delivery_id", 10)]
    assert spark.conf.get(SHUFFLED_BYTES, None) == before
