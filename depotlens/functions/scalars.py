"""Scalar column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Gauge thresholds and colours.
ON_TIME_THRESHOLDS = (0, 50, 75, 100)
ON_TIME_COLOURS = ("red", "orange", "green")
FILL_THRESHOLDS = (0, 50, 90, 100)
FILL_COLOURS = ("green", "orange", "red")


def band(value: Column, thresholds: Sequence[float], colours: Sequence[str]) -> Column:
    """Colour of the left-closed interval that holds ``value``.

    Whatever lies in no interval (the upper limit itself, values outside, NULL) gets the
    last colour.
    """
    inside = [
        F.when((value >= low) & (value < high), colour)
        for low, high, colour in zip(thresholds, thresholds[1:], colours)
    ]
    return F.coalesce(*inside, F.lit(colours[-1]))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as double; NULL when ``whole`` is zero or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def round_half_away(value: Column, digits: int) -> Column:
    """SQL ROUND: ties away from zero, judged on twelve decimals so that the binary noise
    of a division cannot move a tie."""
    return F.round(value.cast("decimal(38,12)"), digits).cast("double")


def round_half_even(value: Column, digits: int) -> Column:
    """Round by scaling, rounding ties to even, and scaling back."""
    scale = float(10 ** digits)
    return F.rint(value * scale) / scale


def percent_text(value: Column) -> Column:
    """``12.5%``: two decimals at most, without trailing zeros beyond the first."""
    return F.concat(round_half_even(value, 2).cast("string"), F.lit("%"))


def fixed_text(value: Column, digits: int = 2) -> Column:
    """``12.50``: a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def whole_days(end: Column, start: Column) -> Column:
    """Days between two dates; a time of day is cut off first."""
    return F.date_diff(F.to_date(end), F.to_date(start))


def fractional_days(df: DataFrame, end: str, start: str) -> Column:
    """Days between two columns including the time of day, on wall-clock time.

    Date columns give whole numbers. Timestamps are compared field by field, so the
    session time zone and its clock changes do not matter.
    """
    days = F.date_diff(F.to_date(end), F.to_date(start)).cast("double")
    if all(isinstance(df.schema[c].dataType, T.DateType) for c in (end, start)):
        return days
    return days + (_second_of_day(end) - _second_of_day(start)) / F.lit(86400.0)


def _second_of_day(column: str) -> Column:
    wall = F.col(column).cast("timestamp_ntz")
    seconds = F.extract(F.lit("SECOND"), wall).cast("double")
    return F.hour(wall) * 3600 + F.minute(wall) * 60 + seconds
