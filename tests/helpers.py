"""Hand-written tables for small cases."""

from __future__ import annotations

import datetime as dt
import uuid

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from depotlens.sources.reader import LazyTables, empty_table
from depotlens.sources.schemas import SPECS

D = dt.date


def make_tables(spark, **rows):
    """Tables from lists of dicts; columns that are not named are NULL, tables not named are empty."""

    def opener(name):
        spec = SPECS[name]
        given = [{c: row.get(c) for c in spec.schema.fieldNames()} for row in rows.get(name, [])]
        if not given:
            return lambda: empty_table(spark, spec)
        return lambda: spark.createDataFrame(pa.Table.from_pylist(given, to_arrow_schema(spec.schema)), spec.schema)

    return LazyTables({name: opener(name) for name in SPECS})


def rows(df):
    return [tuple(r) for r in df.collect()]


def product(code, name, safety=None, volume=None):
    return {"product_code": code, "product_name": name, "safety_stock": safety, "unit_volume": volume}


def warehouse(code, name, capacity=None):
    return {"warehouse_id": code, "warehouse_name": name, "capacity": capacity}


def stock(day, product_code, warehouse_id, available):
    return {"stock_date": day, "product_code": product_code, "warehouse_id": warehouse_id,
            "quantity_available": available}


def sales_tables(spark, lines, order_date=D(2024, 1, 1)):
    """One order holding ``lines`` of (product name, quantity)."""
    names = list(dict.fromkeys(name for name, _ in lines))
    return make_tables(
        spark,
        products=[product(i, name) for i, name in enumerate(names)],
        orders=[{"order_id": 1, "order_date": order_date}],
        order_details=[{"order_id": 1, "product_code": names.index(n), "quantity": q} for n, q in lines],
    )


def most_tasks(spark, job) -> int:
    """Tasks of the widest stage of all that ``job`` runs."""
    context, group = spark.sparkContext, f"tasks-{uuid.uuid4().hex}"
    context.setJobGroup(group, "")
    try:
        job()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return max(info.numTasks for info in map(tracker.getStageInfo, stages) if info)
