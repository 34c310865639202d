"""How long deliveries and shipments take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.functions.filters import Day, in_date_range
from depotlens.functions.scalars import fixed_text, fractional_days, whole_days
from depotlens.operators.extremes import Extreme, arg_extremes
from depotlens.plans.party import Party
from depotlens.sources.reader import Tables

FASTEST, SLOWEST = "fastest", "slowest"


def lead_time(tables: Tables, party: Party, start: Day = None, end: Day = None) -> DataFrame:
    """Transactions of a date range with their lead time in days.

    ``lead_time_days`` includes a time of day where the data has one; ``cycle_lead_time``
    counts whole days. Both are NULL while a transaction is open.
    """
    rows = in_date_range(party.rows(tables, party.id, "order_date", party.actual), "order_date", start, end)
    return rows.select(
        party.id,
        party.partner_name,
        "order_date",
        party.actual,
        fractional_days(rows, party.actual, "order_date").alias("lead_time_days"),
        whole_days(F.col(party.actual), F.col("order_date")).alias("cycle_lead_time"),
    )


def _days(tables: Tables, party: Party, start: Day, end: Day) -> DataFrame:
    """Days and closed transactions per partner id, before names are looked up."""
    days = whole_days(F.col(party.actual), F.col("order_date"))
    return (
        in_date_range(tables[party.table], "order_date", start, end)
        .groupBy(party.partner_id)
        .agg(F.sum(days).alias("days"), F.count(days).alias("closed"))
        .join(party.names(tables), party.partner_id)
    )


def _mean():
    return F.try_divide(F.sum("days").cast("double"), F.sum("closed").cast("double"))


def lead_time_avg(tables: Tables, party: Party, start: Day = None, end: Day = None) -> DataFrame:
    """(avg_days, avg_hours) over closed transactions; NULL when there are none."""
    return _days(tables, party, start, end).agg(_mean().alias("avg_days")).withColumn(
        "avg_hours", F.col("avg_days") * 24)


def lead_time_avg_text(averages: DataFrame) -> DataFrame:
    """The averages as shown on screen, with two decimals."""
    return averages.select(
        F.concat(fixed_text(F.col("avg_days")), F.lit(" (days)")).alias("avg_days"),
        F.concat(fixed_text(F.col("avg_hours")), F.lit(" (hours)")).alias("avg_hours"))


def speed(tables: Tables, party: Party, start: Day = None, end: Day = None) -> DataFrame:
    """(role, partner name, avg_days): smallest and largest mean lead time by name."""
    by_name = _days(tables, party, start, end).groupBy(party.partner_name).agg(_mean().alias("avg_days"))
    roles = [Extreme(FASTEST, "avg_days", largest=False), Extreme(SLOWEST, "avg_days")]
    return arg_extremes(by_name, party.partner_name, roles, "avg_days")
