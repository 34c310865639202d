"""Rows with the largest or smallest value, one per role."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extreme:
    """A role to fill: the name with the largest (or smallest) ``value``."""

    role: str
    value: str
    largest: bool = True


def arg_extremes(df: DataFrame, name: str, roles: Sequence[Extreme], value: str) -> DataFrame:
    """(role, name, value) of the extreme rows of ``df``, found in one pass.

    NULL values never win, equal values go to the smallest name, and a role nobody
    qualifies for has no row.
    """
    def best(extreme: Extreme):
        rank = -F.col(extreme.value) if extreme.largest else F.col(extreme.value)
        winner = F.struct(rank.alias("rank"), F.col(name), F.col(extreme.value).alias("value"))
        return F.min(F.when(F.col(extreme.value).isNotNull() & F.col(name).isNotNull(), winner))

    found = df.agg(*[best(e).alias(e.role) for e in roles])
    rows = F.array(*[
        F.struct(F.lit(e.role).alias("role"), F.col(f"{e.role}.{name}").alias(name),
                 F.col(f"{e.role}.value").alias(value))
        for e in roles
    ])
    return found.select(F.inline(rows)).where(F.col(name).isNotNull())
