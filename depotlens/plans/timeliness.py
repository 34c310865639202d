"""Were deliveries and shipments completed on time?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.functions.filters import Day, in_date_range, named
from depotlens.functions.scalars import ON_TIME_COLOURS, ON_TIME_THRESHOLDS, band, percent
from depotlens.functions.status import COMPLETED_LATE, COMPLETED_ON_TIME
from depotlens.operators.extremes import Extreme, arg_extremes
from depotlens.plans.party import Party
from depotlens.sources.reader import Tables

BEST, WORST = "best", "worst"


def timeliness(tables: Tables, party: Party, start: Day = None, end: Day = None,
               statuses: Sequence[str] | None = None) -> DataFrame:
    """Transactions of a date range with their dates and status.

    ``statuses`` narrows what is shown on screen; the export is called without it.
    """
    rows = in_date_range(
        party.rows(tables, party.id, "order_date", party.expected, party.actual, party.status),
        "order_date", start, end)
    return named(rows, party.status, statuses).select(
        party.id, party.partner_name, "order_date", party.expected, party.actual, party.status)


def _counts(tables: Tables, party: Party, start: Day, end: Day) -> DataFrame:
    """Transactions per partner id: one small row each before names are looked up."""
    status = F.col(party.status)
    return (
        in_date_range(tables[party.table], "order_date", start, end)
        .groupBy(party.partner_id)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(status == COMPLETED_ON_TIME).alias("on_time"),
            F.count_if(status == COMPLETED_LATE).alias("late"),
        )
        .join(party.names(tables), party.partner_id)
    )


def on_time(tables: Tables, party: Party, start: Day = None, end: Day = None) -> DataFrame:
    """(pct_on_time, band) over all transactions of the range, whatever their status."""
    counted = _counts(tables, party, start, end).agg(F.sum("on_time").alias("hits"), F.sum("n").alias("n"))
    return counted.select(percent(F.col("hits"), F.col("n")).alias("pct_on_time")).withColumn(
        "band", band(F.col("pct_on_time"), ON_TIME_THRESHOLDS, ON_TIME_COLOURS))


def extremes(tables: Tables, party: Party, start: Day = None, end: Day = None,
             statuses: Sequence[str] | None = None) -> DataFrame:
    """(role, partner name, n): most on-time and most late transactions, counted by name.

    ``statuses`` keeps the roles that belong to the chosen statuses; another status has
    no role. Nothing chosen means both.
    """
    roles = {COMPLETED_ON_TIME: Extreme(BEST, "on_time"), COMPLETED_LATE: Extreme(WORST, "late")}
    wanted = [e for status, e in roles.items() if not statuses or status in statuses]

    def some(column: str):
        return F.nullif(F.sum(column), F.lit(0)).alias(column)

    by_name = _counts(tables, party, start, end).groupBy(party.partner_name).agg(some("on_time"), some("late"))
    if not wanted:
        return arg_extremes(by_name, party.partner_name, list(roles.values()), "n").where(F.lit(False))
    return arg_extremes(by_name, party.partner_name, wanted, "n")
