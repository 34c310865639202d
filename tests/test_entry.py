import __spark_entry__ as contract
import stored_queries
from depotlens.sources import catalog
from depotlens.sources.star_schema import STAR_ROUTES
from depotlens.session import INITIAL_PARTITIONS, build_session, parallel_tasks, partitions_for


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["warehouse_name", "fill_percentage", "band"]
    assert df.count() > 0


def test_every_query_has_a_stable_schema(spark, small):
    # those that go through files write them when they are called: their columns and types are compared with their SQL
    for name in set(contract.report_queries()) - set(stored_queries.queries(None)):
        query = contract.report_queries()[name]
        first, second = query(spark, small), query(spark, small)
        assert first.schema == second.schema, name


def test_source_inventory_lists_the_routed_files(spark, small):
    df = catalog.source_inventory(spark, small, "parquet", STAR_ROUTES)
    assert {r[0] for r in df.collect()} == {
        "suppliers", "products", "warehouses", "customers", "orders", "order_details"}


def test_shuffle_partitions_follow_the_input(spark):
    assert partitions_for(0) == 1
    assert partitions_for(10**9) == 8
    assert partitions_for(10**14) == 745_059
    before = parallel_tasks(spark)
    try:
        build_session(input_bytes=10**12)
        assert parallel_tasks(spark) == 7451
    finally:
        spark.conf.unset(INITIAL_PARTITIONS)
    assert parallel_tasks(spark) == before
