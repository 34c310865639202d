import random
from decimal import Decimal

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from depotlens.operators.expand import expand_rows
from depotlens.operators.running_total import with_running_total
from depotlens.plans import abc
from tests.helpers import D, make_tables, product, rows, sales_tables


def naive_report(lines, grain):
    """The definition: rows sorted by product total, added up one by one."""
    totals, counts = {}, {}
    for name, quantity in lines:
        totals[name] = totals.get(name, 0) + (quantity or 0)
        counts[name] = counts.get(name, 0) + (1 if grain == "line" else 0)
    ranked = sorted(((totals[n], n) for n in totals for _ in range(counts[n] or 1)), key=lambda r: (-r[0], r[1]))
    grand = sum(total for total, _ in ranked)
    report, cumulative = [], 0
    for total, name in ranked:
        cumulative += total
        category = None
        if 0 < cumulative <= grand:
            category = "A" if cumulative * 100 <= 20 * grand else "B" if cumulative * 100 <= 50 * grand else "C"
        shares = (None, None) if grand == 0 else (total / grand * 100, cumulative / grand * 100)
        report.append((name, total, *shares, category))
    return report


CASES = {
    "bounds": [("a", 20), ("b", 20), ("c", 10), ("d", 10), ("e", 20), ("f", 20)],
    "ties": [("b", 5), ("a", 5), ("c", 5), ("a", 0)],
    "zero product": [("a", 3), ("b", 0), ("b", 0), ("c", 1)],
    "all zero": [("a", 0), ("b", 0)],
    "returns": [("a", 10), ("a", 5), ("b", 4), ("c", -3), ("c", -4), ("d", 0)],
    "mostly returns": [("a", 3), ("b", -9), ("b", -1)],
    "unknown quantity": [("a", None), ("b", 7), ("b", None)],
    "one line": [("a", 1)],
    "hot product": [("hot", 1)] * 40 + [(f"p{i}", i) for i in range(1, 12)],
}
for seed in range(3):
    rng = random.Random(seed)
    CASES[f"random {seed}"] = [(f"p{rng.randrange(9)}", rng.randrange(-3, 12)) for _ in range(60)]


PRODUCT_CASES = ["bounds", "returns", "random 0"]


@pytest.mark.parametrize("case,grain", [(c, "line") for c in CASES] + [(c, "product") for c in PRODUCT_CASES])
def test_report_summary_and_distribution_follow_the_definition(spark, case, grain):
    lines = CASES[case]
    tables = sales_tables(spark, lines)
    expected = naive_report(lines, grain)
    assert rows(abc.abc_report(tables, grain=grain)) == expected
    counts = [sum(r[4] == label for r in expected) for label in "ABC"]
    assert rows(abc.abc_summary(tables, grain=grain)) == [
        (*counts, sum(counts), Decimal(sum(r[1] for r in expected)))]
    pct = {label: (n / sum(counts) * 100 if sum(counts) else None) for label, n in zip("ABC", counts)}
    got = rows(abc.abc_distribution(tables, grain=grain))
    assert dict(got) == pct
    assert [r[0] for r in got] == sorted(pct, key=lambda label: (-(pct[label] or 0), label))


def test_top_product(spark):
    assert rows(abc.abc_top_product(sales_tables(spark, [("b", 5), ("a", 5), ("c", 1)]))) == [("a", 5)]
    assert rows(abc.abc_top_product(make_tables(spark))) == []


def test_empty_range_has_an_empty_report_and_zero_counts(spark):
    tables = sales_tables(spark, [("a", 1)], D(2024, 5, 1))
    assert rows(abc.abc_report(tables, "2025-01-01")) == []
    assert rows(abc.abc_summary(tables, "2025-01-01")) == [(0, 0, 0, 0, Decimal(0))]
    assert rows(abc.abc_report(tables, "2024-05-01", "2024-05-01")) == [("a", 1, 100.0, 100.0, "C")]
    assert rows(abc.sales_date_bounds(tables)) == [(D(2024, 5, 1), D(2024, 5, 1))]
    with pytest.raises(ValueError):
        abc.abc_report(tables, "2024-05-02", "2024-05-01")
    with pytest.raises(ValueError):
        abc.abc_report(tables, grain="week")


def test_products_of_one_name_are_one_product_and_orphans_drop_out(spark):
    tables = make_tables(
        spark,
        products=[product(1, "x"), product(2, "x"), product(3, None)],
        orders=[{"order_id": 1, "order_date": D(2024, 1, 1)}, {"order_id": 2}],
        order_details=[
            {"order_id": o, "product_code": p, "quantity": q}
            for o, p, q in [(1, 1, 2), (1, 2, 3), (1, 3, 9), (1, 8, 50), (2, 1, 70), (7, 1, 90)]],
    )
    # the undated order is in no range; an unnamed product is listed last, without figures
    assert rows(abc.abc_report(tables)) == [
        ("x", 5, 50.0, 50.0, "B"), ("x", 5, 50.0, 100.0, "C"), (None, None, None, None, None)]
    assert rows(abc.abc_summary(tables)) == [(0, 1, 1, 2, Decimal(10))]


def test_report_text(spark):
    tables = sales_tables(spark, [("a", 2), ("b", 1)])
    assert rows(abc.abc_report_text(abc.abc_report(tables))) == [
        ("a", 2, "66.67%", "66.67%", "C"), ("b", 1, "33.33%", "100.0%", "C")]


def test_weights_beyond_64_bits(spark):
    sales = spark.createDataFrame(
        [("hot", 4 * 10**13, 10**12), ("warm", 3 * 10**13, 10**12), ("cold", 10**6, 5)],
        "product_name STRING, total_sales BIGINT, row_count BIGINT")
    ranked = {r["product_name"]: r for r in abc.ranked_products(sales).collect()}
    grand = 7 * 10**25 + 5 * 10**6
    assert ranked["cold"]["grand_total"] == grand
    assert ranked["cold"]["weight_before"] == 7 * 10**25
    assert ranked["hot"]["within_20"] == grand * 20 // 100 // (4 * 10**13)
    assert ranked["hot"]["within_50"] == grand * 50 // 100 // (4 * 10**13)
    assert ranked["warm"]["within_100"] == 10**12
    assert ranked["cold"]["within_50"] == 0


def test_report_equals_naive_window_on_real_lines(star):
    lines = (
        star["order_details"].join(star["orders"].select("order_id"), "order_id")
        .join(star["products"].select("product_code", "product_name"), "product_code")
        .select("product_name", "quantity"))
    assert rows(abc.abc_report(star)) == naive_report(rows(lines), "line")


def test_running_total_equals_one_global_window(spark):
    rng = random.Random(5)
    data = [(f"n{i}", rng.randrange(40), rng.randrange(-5, 50)) for i in range(5000)]
    df = spark.createDataFrame(data, "name STRING, rank INT, w BIGINT").repartition(7)
    order = [F.col("rank"), F.col("name")]
    got = with_running_total(df, order, F.col("w"), buckets=16)
    earlier = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    expected = df.select("*", F.coalesce(F.sum("w").over(earlier), F.lit(0)), F.lit(sum(r[2] for r in data)))
    columns = ["name", "rank", "w", "weight_before", "grand_total"]
    assert sorted(rows(got.select(columns))) == sorted(rows(expected))


def test_running_total_of_few_and_no_rows(spark):
    df = spark.createDataFrame([("a", 2), ("b", 3)], "name STRING, w BIGINT")
    got = with_running_total(df, [F.col("name")], F.col("w")).select("name", "w", "weight_before", "grand_total")
    assert sorted(rows(got)) == [("a", 2, 0, 5), ("b", 3, 2, 5)]
    assert rows(with_running_total(df.where("w > 9"), [F.col("name")], F.col("w"))) == []


def test_expansion_is_complete_ordered_and_even(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1003), ("c", 10), ("d", 20), ("e", 0), ("f", None)], "name STRING, n BIGINT")
    placed = with_running_total(df, [F.col("name")], F.col("n"), "before", "total")
    got = expand_rows(placed, "n", "k", [F.col("name")], "before", "total", tasks=10).select("name", "n", "k")
    expected = [(name, n, k) for name, n in sorted(rows(df)) for k in range(1, (n or 0) + 1)]
    assert rows(got) == expected
    tasks = rows(got.groupBy(F.spark_partition_id()).count())
    assert len(tasks) == 10 and max(n for _, n in tasks) == 104
    assert rows(expand_rows(placed.where("n > 9999"), "n", "k", [F.col("name")], "before", "total")) == []
