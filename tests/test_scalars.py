import datetime as dt
import math
import random

import numpy as np

from pyspark.sql import functions as F

from depotlens.functions import scalars
from depotlens.functions.scalars import (FILL_COLOURS, FILL_THRESHOLDS, ON_TIME_COLOURS, ON_TIME_THRESHOLDS, band,
                                         fixed_text, fractional_days, percent, percent_text, round_half_away,
                                         round_half_even, whole_days)
from tests.helpers import rows


def apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, x DOUBLE")
    return [r[0] for r in rows(df.orderBy("i").select(expression(F.col("x"))))]


def test_bands_are_left_closed_and_end_in_the_last_colour(spark):
    values = [0.0, 49.99, 50.0, 74.99, 75.0, 99.99, 100.0, 120.0, -1.0, None]
    assert apply(spark, values, lambda x: band(x, ON_TIME_THRESHOLDS, ON_TIME_COLOURS)) == [
        "red", "red", "orange", "orange", "green", "green", "green", "green", "green", "green"]
    assert apply(spark, [0.0, 50.0, 89.99, 90.0, 100.0, 400.0, None],
                 lambda x: band(x, FILL_THRESHOLDS, FILL_COLOURS)) == [
        "green", "orange", "orange", "red", "red", "red", "red"]


def test_percent_of_nothing_is_null(spark):
    assert apply(spark, [0.0, 4.0, None], lambda x: percent(F.lit(1), x)) == [None, 25.0, None]


def test_sql_rounding_moves_ties_away_from_zero(spark):
    values = [0.025, 0.125, -0.125, 1.025, 2.344999, 1.005]
    assert apply(spark, values, lambda x: round_half_away(x, 2)) == [0.03, 0.13, -0.13, 1.03, 2.34, 1.01]


def test_report_rounding_equals_numpy(spark):
    rng = random.Random(3)
    values = [0.005, 0.015, 0.125, 2.675, -0.005] + [rng.uniform(0, 100) for _ in range(500)]
    values += [rng.randrange(0, 20000) / 200 for _ in range(500)]
    got = apply(spark, values, lambda x: round_half_even(x, 2))
    assert got == [float(v) for v in np.round(values, 2)]


def test_percent_text_has_no_padding(spark):
    assert apply(spark, [12.5, 100.0, 0.001, 33.333333, 7.0], percent_text) == [
        "12.5%", "100.0%", "0.0%", "33.33%", "7.0%"]


def test_fixed_text(spark):
    assert apply(spark, [12.5, 3.14159], fixed_text) == ["12.50", "3.14"]


def test_whole_days_cut_the_time_off(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 3, 2, 1), dt.datetime(2024, 3, 1, 23)), (None, dt.datetime(2024, 3, 1))],
        "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    assert rows(df.select(whole_days(F.col("a"), F.col("b")))) == [(1,), (None,)]


def test_fractional_days(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 3, 31, 12, 30, 15), dt.datetime(2024, 3, 30, 6)), (dt.datetime(2024, 3, 31), None)],
        "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    (first,), (second,) = rows(df.select(fractional_days(df, "a", "b")))
    assert math.isclose(first, 1 + (6.5 * 3600 + 15) / 86400)
    assert second is None


def test_fractional_days_ignore_clock_changes(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.sql("SELECT TIMESTAMP '2024-04-01 00:00:00' AS a, TIMESTAMP '2024-03-31 00:00:00' AS b, "
                       "DATE '2024-04-01' AS c, DATE '2024-03-31' AS d")
        assert rows(df.select(fractional_days(df, "a", "b"), fractional_days(df, "c", "d"))) == [(1.0, 1.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_thresholds_fit_their_colours():
    assert len(scalars.FILL_THRESHOLDS) == len(scalars.FILL_COLOURS) + 1
    assert len(scalars.ON_TIME_THRESHOLDS) == len(scalars.ON_TIME_COLOURS) + 1
