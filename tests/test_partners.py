import datetime as dt

import pytest

from depotlens.functions.status import COMPLETED_LATE, COMPLETED_ON_TIME
from depotlens.plans import choices, lead_time, timeliness
from depotlens.plans.party import CUSTOMER, SUPPLIER
from depotlens.sources.reader import LazyTables
from tests.helpers import D, make_tables, rows

ON, LATE, OPEN = COMPLETED_ON_TIME, COMPLETED_LATE, "In progress"


def both(spark, cases, names=("ann", "bob", "cid")):
    """The same transactions once as deliveries and once as orders."""
    deliveries = [
        {"delivery_id": i, "supplier_id": p, "order_date": d, "expected_delivery_date": d, "delivery_date": done,
         "delivery_status": s} for i, (p, d, done, s) in enumerate(cases)]
    orders = [
        {"order_id": i, "customer_id": p, "order_date": d, "expected_shipping_date": d, "shipping_date": done,
         "shipping_status": s} for i, (p, d, done, s) in enumerate(cases)]
    return make_tables(
        spark, deliveries=deliveries, orders=orders,
        suppliers=[{"supplier_id": i, "supplier_name": n} for i, n in enumerate(names)],
        customers=[{"customer_id": i, "customer_name": n} for i, n in enumerate(names)])


def day(n):
    return D(2024, 1, n)


CASES = [
    (0, day(1), day(3), ON), (0, day(2), day(12), LATE), (1, day(2), day(4), ON), (1, day(3), None, OPEN),
    (1, day(5), day(15), LATE), (2, day(6), None, None), (9, day(1), day(2), ON), (2, None, day(8), ON),
]
PARTIES = pytest.mark.parametrize("party", [SUPPLIER, CUSTOMER], ids=["supplier", "customer"])


@pytest.fixture(scope="module")
def tables(spark):
    return both(spark, CASES)


@PARTIES
def test_listing(tables, party):
    got = sorted(rows(timeliness.timeliness(tables, party)))
    assert [r[0] for r in got] == [0, 1, 2, 3, 4, 5]
    assert got[1] == (1, "ann", day(2), day(2), day(12), LATE)
    assert [r[0] for r in sorted(rows(timeliness.timeliness(tables, party, day(2), day(3))))] == [1, 2, 3]
    assert [r[0] for r in rows(timeliness.timeliness(tables, party, statuses=[OPEN]))] == [3]
    assert timeliness.timeliness(tables, party).columns == [
        party.id, party.partner_name, "order_date", party.expected, party.actual, party.status]


@PARTIES
def test_rate_counts_rows_without_status(tables, party):
    assert rows(timeliness.on_time(tables, party)) == [(2 / 6 * 100, "red")]
    assert rows(timeliness.on_time(tables, party, day(1), day(1))) == [(100.0, "green")]
    assert rows(timeliness.on_time(tables, party, day(1), day(2))) == [(2 / 3 * 100, "orange")]


@PARTIES
def test_rate_of_an_empty_range(tables, party):
    assert rows(timeliness.on_time(tables, party, day(30))) == [(None, "green")]


@PARTIES
def test_extremes_break_ties_by_name(tables, party):
    assert rows(timeliness.extremes(tables, party)) == [("best", "ann", 1), ("worst", "ann", 1)]
    assert rows(timeliness.extremes(tables, party, day(2))) == [("best", "bob", 1), ("worst", "ann", 1)]
    assert rows(timeliness.extremes(tables, party, day(3))) == [("worst", "bob", 1)]
    assert rows(timeliness.extremes(tables, party, day(30))) == []


def test_chosen_statuses_pick_the_roles(tables):
    def roles(statuses):
        return [r[0] for r in rows(timeliness.extremes(tables, CUSTOMER, statuses=statuses))]

    assert roles([LATE]) == ["worst"]
    assert roles([OPEN, ON]) == ["best"]
    assert roles([OPEN]) == []
    assert roles([]) == ["best", "worst"]


@PARTIES
def test_partners_of_one_name_count_together_and_unnamed_never_win(spark, party):
    cases = [(0, day(1), day(2), ON)] * 3 + [(1, day(1), day(2), ON)] + [(2, day(1), day(2), ON)]
    tables = both(spark, cases, names=(None, "twin", "twin"))
    assert rows(timeliness.extremes(tables, party)) == [("best", "twin", 2)]
    assert rows(timeliness.on_time(tables, party)) == [(100.0, "green")]


@PARTIES
def test_lead_time_listing(tables, party):
    got = sorted(rows(lead_time.lead_time(tables, party)))
    assert got[0] == (0, "ann", day(1), day(3), 2.0, 2)
    assert got[3] == (3, "bob", day(3), None, None, None)
    assert len(got) == 6


@PARTIES
def test_lead_time_average_skips_open_transactions(tables, party):
    assert rows(lead_time.lead_time_avg(tables, party)) == [(6.0, 144.0)]
    assert rows(lead_time.lead_time_avg(tables, party, day(3), day(3))) == [(None, None)]
    assert rows(lead_time.lead_time_avg_text(lead_time.lead_time_avg(tables, party))) == [
        ("6.00 (days)", "144.00 (hours)")]


@PARTIES
def test_speed_by_name(tables, party):
    assert rows(lead_time.speed(tables, party)) == [("fastest", "ann", 6.0), ("slowest", "ann", 6.0)]
    assert rows(lead_time.speed(tables, party, day(2))) == [("fastest", "bob", 6.0), ("slowest", "ann", 10.0)]
    assert rows(lead_time.speed(tables, party, day(6))) == []


def test_lead_time_keeps_a_time_of_day(spark, tables):
    timed = spark.createDataFrame(
        [(1, 0, dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 3, 6))],
        "delivery_id BIGINT, supplier_id BIGINT, order_date TIMESTAMP_NTZ, delivery_date TIMESTAMP_NTZ")
    mixed = LazyTables({"deliveries": lambda: timed, "suppliers": lambda: tables["suppliers"]})
    assert rows(lead_time.lead_time(mixed, SUPPLIER).select("lead_time_days", "cycle_lead_time")) == [(1.75, 2)]


@PARTIES
def test_choices_and_bounds(tables, party):
    assert {r[0] for r in rows(choices.status_choices(tables, party))} == {ON, LATE, OPEN, None}
    assert rows(choices.order_date_bounds(tables, party)) == [(day(1), day(6))]


@PARTIES
def test_bad_range_is_refused_before_planning(tables, party):
    for job in (timeliness.timeliness, timeliness.on_time, timeliness.extremes, lead_time.lead_time,
                lead_time.lead_time_avg, lead_time.speed):
        with pytest.raises(ValueError):
            job(tables, party, day(2), day(1))
