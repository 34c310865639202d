import datetime as dt

import pytest

from depotlens.functions.filters import (ALL_DATES, in_date_range, matching_like, matching_regex, named, on_dates,
                                         validate_range)
from tests.helpers import D, rows


@pytest.fixture
def words(spark):
    texts = ["Red Ring", "red_ring", "100% cotton", "a.b", "a(b", "back\\slash", "ÄPFEL", None]
    return spark.createDataFrame([(t,) for t in texts], "product_name STRING")


def found(df):
    return sorted(r[0] for r in rows(df))


def like(words, term):
    return found(matching_like(words, "product_name", term))


def test_like_ignores_ascii_case_and_keeps_wildcards(words):
    assert like(words, "RING") == ["Red Ring", "red_ring"]
    assert like(words, "red_ring") == ["Red Ring", "red_ring"]
    assert like(words, "d%g") == ["Red Ring", "red_ring"]
    assert like(words, "0%c") == ["100% cotton"]


def test_like_takes_regex_signs_and_backslashes_literally(words):
    assert like(words, "a.b") == ["a.b"]
    assert like(words, "(") == ["a(b"]
    assert like(words, "k\\s") == ["back\\slash"]
    assert like(words, "\\%") == ["back\\slash"]


def test_like_compares_other_letters_exactly(words):
    assert like(words, "Äpf") == ["ÄPFEL"]
    assert like(words, "äpf") == []


def test_no_term_keeps_everything(words):
    assert matching_like(words, "product_name", "").count() == 8
    assert matching_regex(words, "product_name", None).count() == 8


def test_regex_search(words):
    def search(term):
        return found(matching_regex(words, "product_name", term))

    assert search("^RED.ring$") == ["Red Ring", "red_ring"]
    assert search("a\\.b") == ["a.b"]
    assert search("a.b") == ["a(b", "a.b"]
    assert search("äpf") == ["ÄPFEL"]


def test_names_empty_means_all(words):
    assert named(words, "product_name", []).count() == 8
    assert found(named(words, "product_name", ["a.b", "absent"])) == ["a.b"]


def test_range_validation():
    assert validate_range("2024-01-02", D(2024, 1, 2)) == (D(2024, 1, 2), D(2024, 1, 2))
    assert validate_range(None, None) == (None, None)
    with pytest.raises(ValueError):
        validate_range("2024-01-03", "2024-01-02")


def test_range_is_inclusive_and_drops_undated_rows(spark):
    days = [D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3), None]
    df = spark.createDataFrame([(d,) for d in days], "order_date DATE")

    def kept(start=None, end=None):
        return found(in_date_range(df, "order_date", start, end))

    assert kept("2024-01-02", "2024-01-03") == days[1:3]
    assert kept("2024-01-02", "2024-01-02") == days[1:2]
    assert kept(end="2024-01-01") == days[:1]
    assert kept() == days[:3]
    assert kept("2030-01-01") == []


def test_chosen_dates(spark):
    days = [D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 2), None]
    df = spark.createDataFrame([(d,) for d in days], "stock_date DATE")
    assert found(on_dates(df, "stock_date", None)) == [D(2024, 1, 2)] * 2
    assert found(on_dates(df, "stock_date", [])) == [D(2024, 1, 2)] * 2
    assert found(on_dates(df, "stock_date", ["2024-01-01", D(2020, 1, 1)])) == [D(2024, 1, 1)]
    assert found(on_dates(df, "stock_date", ALL_DATES)) == days[:3]
    assert isinstance(days[0], dt.date)
