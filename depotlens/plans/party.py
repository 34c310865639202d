"""Suppliers and customers are measured alike; a Party names the columns that differ."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from depotlens.sources.reader import Tables


@dataclass(frozen=True)
class Party:
    """A transaction table and the partner table its rows belong to."""

    table: str
    id: str
    partners: str
    partner_id: str
    partner_name: str
    expected: str
    actual: str
    status: str

    def rows(self, tables: Tables, *columns: str) -> DataFrame:
        """Transactions that have a partner, with the partner's name.

        No join strategy is forced: a measured small partner table is broadcast, beyond
        that the join shuffles and skewed partners are split.
        """
        facts = tables[self.table].select(self.partner_id, *columns)
        return facts.join(self.names(tables), self.partner_id)

    def names(self, tables: Tables) -> DataFrame:
        return tables[self.partners].select(self.partner_id, self.partner_name)


SUPPLIER = Party(
    table="deliveries",
    id="delivery_id",
    partners="suppliers",
    partner_id="supplier_id",
    partner_name="supplier_name",
    expected="expected_delivery_date",
    actual="delivery_date",
    status="delivery_status",
)

CUSTOMER = Party(
    table="orders",
    id="order_id",
    partners="customers",
    partner_id="customer_id",
    partner_name="customer_name",
    expected="expected_shipping_date",
    actual="shipping_date",
    status="shipping_status",
)
