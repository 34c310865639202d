"""Values a report can be narrowed to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotlens.functions.filters import ALL_DATES
from depotlens.plans.party import Party
from depotlens.plans.shortages import shortages
from depotlens.sources.reader import Tables


def stock_dates(tables: Tables) -> DataFrame:
    """Snapshot dates, oldest first."""
    return tables["warehouse_stock"].select("stock_date").distinct().orderBy("stock_date")


def warehouse_choices(tables: Tables) -> DataFrame:
    return tables["warehouses"].select("warehouse_name").distinct()


def status_choices(tables: Tables, party: Party) -> DataFrame:
    """Statuses of transactions that have a partner, as the reports show them."""
    pairs = tables[party.table].select(party.status, party.partner_id).distinct()
    return pairs.join(tables[party.partners], party.partner_id, "left_semi").select(party.status).distinct()


def shortage_dates(tables: Tables) -> DataFrame:
    """Dates with a shortage, oldest first."""
    return shortages(tables, ALL_DATES).select("stock_date").distinct().orderBy("stock_date")


def order_date_bounds(tables: Tables, party: Party) -> DataFrame:
    """Default range of the timeliness and lead-time reports: only rows with a known partner.

    Dates are reduced to two per partner id before partners are looked up.
    """
    per_partner = tables[party.table].groupBy(party.partner_id).agg(
        F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    known = per_partner.join(tables[party.partners], party.partner_id, "left_semi")
    return known.agg(F.min("first").alias("min_date"), F.max("last").alias("max_date"))
