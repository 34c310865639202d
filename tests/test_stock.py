from decimal import Decimal

import pytest

from depotlens.functions.filters import ALL_DATES
from depotlens.plans import choices, fill, shortages, stock as stock_plans
from tests.helpers import D, make_tables, product, rows, stock, warehouse

DAY1, DAY2, DAY3 = D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3)


@pytest.fixture(scope="module")
def tables(spark):
    return make_tables(
        spark,
        products=[product(1, "Iron Bolt", 10), product(2, "iron nut", 5), product(3, "Wood", None)],
        warehouses=[warehouse(1, "North"), warehouse(2, "South"), warehouse(3, "South")],
        warehouse_stock=[
            stock(DAY1, 1, 1, 4), stock(DAY1, 1, 2, 12), stock(DAY1, 2, 3, 5), stock(DAY1, 9, 1, 100),
            stock(DAY2, 1, 1, 9), stock(DAY2, 2, 2, 1), stock(DAY2, 3, 3, 7), stock(DAY2, 1, 9, 50),
            stock(DAY3, 3, 1, 8), stock(DAY3, 2, 1, None), stock(None, 1, 1, 3),
        ],
    )


def test_status_default_is_the_latest_date(tables):
    assert sorted(rows(stock_plans.stock_status(tables)), key=str) == [
        (DAY3, "Wood", "North", 8), (DAY3, "iron nut", "North", None)]


def test_status_drops_orphans_and_filters(tables):
    got = rows(stock_plans.stock_status(tables, [DAY1, DAY2], ["North", "South"], "IRON"))
    assert sorted(got) == [
        (DAY1, "Iron Bolt", "North", 4), (DAY1, "Iron Bolt", "South", 12), (DAY1, "iron nut", "South", 5),
        (DAY2, "Iron Bolt", "North", 9), (DAY2, "iron nut", "South", 1)]
    assert stock_plans.stock_status(tables, ALL_DATES).count() == 8


def test_totals_follow_the_filters_and_show_zeros(tables):
    totals = stock_plans.stock_totals_by_date
    assert sorted(rows(totals(tables, ALL_DATES))) == [(DAY1, 21), (DAY2, 17), (DAY3, 8)]
    assert sorted(rows(totals(tables, ALL_DATES, term="bolt"))) == [(DAY1, 16), (DAY2, 9), (DAY3, 0)]
    asked = ["2024-01-01", D(1999, 1, 1), "2024-01-03"]
    assert sorted(rows(totals(tables, asked, ["South"]))) == [(D(1999, 1, 1), 0), (DAY1, 17), (DAY3, 0)]
    assert rows(totals(tables, term="no such thing")) == [(DAY3, 0)]


def test_totals_of_an_empty_stock_table(spark):
    empty = make_tables(spark)
    assert rows(stock_plans.stock_totals_by_date(empty)) == []
    assert rows(stock_plans.stock_totals_by_date(empty, [DAY1])) == [(DAY1, 0)]


def test_trend_merges_warehouses_by_name_and_keeps_unknown_products(tables):
    assert sorted(rows(stock_plans.stock_trend(tables, ALL_DATES))) == [
        (DAY1, "North", 104), (DAY1, "South", 17), (DAY2, "North", 9), (DAY2, "South", 8), (DAY3, "North", 8)]


def test_trend_is_shown_or_not_by_the_product_filter(tables):
    assert sorted(rows(stock_plans.stock_trend(tables, [DAY2], term="bolt"))) == [
        (DAY2, "North", 9), (DAY2, "South", 8)]
    assert rows(stock_plans.stock_trend(tables, [DAY2], term="absent")) == []


def test_choices(tables):
    assert rows(choices.stock_dates(tables)) == [(None,), (DAY1,), (DAY2,), (DAY3,)]
    assert sorted(rows(choices.warehouse_choices(tables))) == [("North",), ("South",)]


def test_shortages_compare_each_warehouse_with_the_product_level(tables):
    # the second bolt row of the first date is above its level, one row has no known quantity
    assert rows(shortages.shortages(tables, ALL_DATES)) == [
        (DAY1, "Iron Bolt", 4, 10, 6), (DAY2, "Iron Bolt", 9, 10, 1), (DAY2, "iron nut", 1, 5, 4)]


def test_shortage_default_is_the_latest_date_with_a_shortage(tables):
    assert {r[0] for r in rows(shortages.shortages(tables))} == {DAY2}
    assert rows(shortages.shortages(tables, term="^wood")) == []
    assert rows(shortages.shortage_totals_by_date(tables, term="^wood")) == [(DAY2, 0)]


def test_shortage_sums(tables):
    assert sorted(rows(shortages.shortage_totals_by_date(tables, ALL_DATES))) == [(DAY1, 6), (DAY2, 5)]
    assert rows(shortages.shortage_bars(tables, ALL_DATES, "NUT$")) == [(DAY1, 0, 0), (DAY2, 1, 4)]
    assert rows(shortages.shortage_bars(tables, [DAY3, DAY1])) == [(DAY1, 4, 6), (DAY3, 0, 0)]


def test_shortage_view_hides_the_date(tables):
    assert shortages.shortages_view(shortages.shortages(tables)).columns == [
        "product_name", "quantity_available", "safety_stock", "missing_quantity"]


def test_fill_edges(spark):
    volume = Decimal("0.50")
    tables = make_tables(
        spark,
        products=[product(1, "box", volume=volume), product(2, "big", volume=Decimal("1.00"))],
        warehouses=[
            warehouse(1, "zero", 0), warehouse(2, "unknown", None), warehouse(3, "over", 10), warehouse(4, "half", 10),
            warehouse(5, "ninety", 10), warehouse(6, "full", 10), warehouse(7, "twin", 10), warehouse(8, "twin", 10),
            warehouse(9, "absent", 10), warehouse(10, "tie", 4000), warehouse(11, "integers", 100)],
        warehouse_stock=[
            stock(DAY2, 1, 1, 5), stock(DAY2, 1, 2, 5), stock(DAY2, 1, 3, 30), stock(DAY2, 1, 4, 10),
            stock(DAY2, 1, 5, 18), stock(DAY2, 1, 6, 20), stock(DAY2, 1, 7, 4), stock(DAY2, 1, 8, 6),
            stock(DAY1, 1, 9, 6), stock(DAY2, 2, 10, 1), stock(DAY2, 2, 11, 15)],
    )
    assert sorted(rows(fill.fill_levels(tables))) == [
        ("full", 100.0, "red"), ("half", 50.0, "orange"), ("integers", 15.0, "green"), ("ninety", 90.0, "red"),
        ("over", 150.0, "red"), ("tie", 0.03, "green"), ("twin", 50.0, "orange"), ("unknown", None, "red"),
        ("zero", None, "red")]
    assert rows(fill.fill_levels(tables, DAY1)) == [("absent", 30.0, "green")]
    assert sorted(rows(fill.fill_levels(tables, "2024-01-02", ["half", "absent"]))) == [("half", 50.0, "orange")]


def test_trend_adds_up_to_status_without_product_filter(star):
    trend = stock_plans.stock_trend(star, ALL_DATES).agg({"quantity_available": "sum"})
    status = stock_plans.stock_status(star, ALL_DATES).agg({"quantity_available": "sum"})
    assert rows(trend) == rows(status)
