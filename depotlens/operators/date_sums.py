"""Sums per date, zero where a chosen date has nothing to add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.functions.filters import ALL_DATES, Dates, date_literals


def sum_by_date(rows: DataFrame, column: str, sums: dict[str, Column], dates: Dates) -> DataFrame:
    """One row per date with the named sums.

    ``rows`` holds the rows of the chosen dates. Values that a filter excludes come as
    NULL and not as missing rows, so a date keeps its row with the sum 0. Dates that were
    asked for by name and have no rows at all join in as rows of zeros: there is one pass
    over the data, one shuffle of partial sums and no join.
    """
    values = rows.select(column, *[value.cast("bigint").alias(name) for name, value in sums.items()])
    if isinstance(dates, DataFrame):
        asked = dates.select(F.col(dates.columns[0]).cast("date").alias(column)).where(F.col(column).isNotNull())
        zeros = asked.select(column, *[F.lit(0).cast("bigint").alias(name) for name in sums])
        values = values.unionByName(zeros)
    elif dates and dates != ALL_DATES:
        days = F.array(*[F.lit(day) for day in date_literals(dates)])
        zeros = rows.sparkSession.range(1).select(
            F.explode(days).alias(column), *[F.lit(0).cast("bigint").alias(name) for name in sums])
        values = values.unionByName(zeros)
    return values.groupBy(column).agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in sums])


def date_bounds(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest date: the default range of a report."""
    return df.agg(F.min(column).alias("min_date"), F.max(column).alias("max_date"))
