"""Row filters shared by the reports."""

from __future__ import annotations

import datetime as dt
import string
from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL_DATES: Literal["all"] = "all"
# a choice is listed, or lies in the first column of a table
Dates = Sequence[dt.date | str] | DataFrame | Literal["all"] | None
Names = Sequence[str] | DataFrame | None
Day = dt.date | str | None


def _as_date(day: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day


def date_literals(days: Sequence[dt.date | str]) -> list[dt.date]:
    """Distinct dates in ascending order."""
    return sorted({_as_date(d) for d in days})


def validate_range(start: Day, end: Day) -> tuple[dt.date | None, dt.date | None]:
    """Both ends as dates; None is an open end. Equal days are a valid one-day range."""
    first = None if start is None else _as_date(start)
    last = None if end is None else _as_date(end)
    if first is not None and last is not None and first > last:
        raise ValueError(f"start date {first} is later than end date {last}")
    return first, last


def in_date_range(df: DataFrame, column: str, start: Day = None, end: Day = None) -> DataFrame:
    """Rows whose date lies between ``start`` and ``end``, both included.

    Undated rows are in no range, not even the open one, whose defaults are the smallest
    and largest date of the data.
    """
    first, last = validate_range(start, end)
    day = F.col(column)
    df = df.where(day.isNotNull())
    if first is not None:
        df = df.where(day >= F.lit(first))
    if last is not None:
        df = df.where(day <= F.lit(last))
    return df


def latest(df: DataFrame, column: str) -> Column:
    """Largest value of a column as a scalar subquery: no driver round trip, and the
    value is pushed into the scan like a literal."""
    return df.agg(F.max(column)).scalar()


def chosen_in(df: DataFrame, column: str, choices: DataFrame) -> DataFrame:
    """Rows whose value is in the first column of ``choices``, a table of any size.

    A semi join: a measured small table is broadcast, others are shuffled, and where ``column`` is one that the stored
    table is partitioned by, only the directories of the chosen values are read.
    """
    wanted = choices.select(F.col(choices.columns[0]).cast(df.schema[column].dataType).alias(column)).distinct()
    return df.join(wanted, column, "left_semi").select(*df.columns)


def on_dates(df: DataFrame, column: str, dates: Dates) -> DataFrame:
    """Rows of the chosen dates. Nothing chosen means the latest date of ``df``; an empty table of choices is a choice
    of no date."""
    if isinstance(dates, DataFrame):
        return chosen_in(df, column, dates)
    if dates == ALL_DATES:
        return df.where(F.col(column).isNotNull())
    if not dates:
        return df.where(F.col(column) == latest(df, column))
    return df.where(F.col(column).isin(date_literals(dates)))


def named(df: DataFrame, column: str, names: Names) -> DataFrame:
    """Rows whose name is chosen; an empty list does not filter, an empty table leaves nothing."""
    if isinstance(names, DataFrame):
        return chosen_in(df, column, names)
    return df.where(F.col(column).isin(list(names))) if names else df


def matching_like(df: DataFrame, column: str, term: str | None) -> DataFrame:
    """Rows containing ``term`` as in ``LIKE '%term%'``.

    ``%`` and ``_`` inside the term are wildcards, a backslash is an ordinary character,
    and only ASCII letters compare without case.
    """
    if not term:
        return df
    lowered = term.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    pattern = "%" + lowered.replace("\\", "\\\\") + "%"
    return df.where(F.translate(column, string.ascii_uppercase, string.ascii_lowercase).like(pattern))


def regex_found(column: str, term: str | None) -> Column:
    """Whether the regular expression ``term`` is found, ignoring case; no term is found
    everywhere."""
    return F.col(column).rlike("(?iu)" + term) if term else F.lit(True)


def matching_regex(df: DataFrame, column: str, term: str | None) -> DataFrame:
    """Rows in which the regular expression ``term`` is found, ignoring case."""
    return df.where(regex_found(column, term)) if term else df
