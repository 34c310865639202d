"""DuckDB SQL that states, independently of Spark, what each registered query returns.

The common table expressions are the views of FIXTURES.md over the star schema.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "suppliers": "SELECT s_suppkey AS supplier_id, s_name AS supplier_name FROM supplier",
    "products": """
        SELECT p_partkey AS product_code, p_name AS product_name, p_size AS safety_stock,
               p_size AS unit_height, p_size AS unit_width, p_size AS unit_depth,
               CAST(p_size * 0.25 AS DECIMAL(5,2)) AS unit_volume FROM part""",
    "warehouses": """
        SELECT n_nationkey AS warehouse_id, n_name AS warehouse_name, 250 * n_nationkey AS capacity FROM nation""",
    "warehouse_stock": """
        SELECT stock_date, product_code, warehouse_id, quantity_on_hand, quantity_reserved,
               quantity_on_hand - quantity_reserved AS quantity_available
        FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS stock_date, l_partkey AS product_code,
                     s_nationkey AS warehouse_id,
                     CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity_on_hand,
                     CAST(SUM(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT)
                         AS quantity_reserved
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3) t""",
    "customers": "SELECT c_custkey AS customer_id, c_name AS customer_name FROM customer",
    "inv_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS order_date,
               CAST(o_orderdate AS DATE) + 14 AS expected_shipping_date,
               CASE WHEN o_orderstatus = 'P' THEN NULL
                    ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) END AS shipping_date,
               CASE WHEN o_orderstatus = 'P' THEN 'In progress'
                    WHEN o_orderkey % 30 <= 14 THEN 'Completed on time'
                    ELSE 'Completed with a delay' END AS shipping_status,
               o_orderpriority AS sales_channel FROM orders""",
    "order_details": """
        SELECT l_orderkey AS order_id, l_partkey AS product_code, CAST(l_quantity AS BIGINT) AS quantity
        FROM lineitem""",
    "deliveries": """
        SELECT l_orderkey || '-' || l_suppkey AS delivery_id, l_suppkey AS supplier_id,
               CAST(o_orderdate AS DATE) AS order_date, CAST(o_orderdate AS DATE) + 14 AS expected_delivery_date,
               CASE WHEN l_orderkey % 7 = 0 THEN NULL
                    ELSE CAST(o_orderdate AS DATE) + CAST((l_orderkey + l_suppkey) % 30 AS INT) END AS delivery_date,
               CASE WHEN l_orderkey % 7 = 0 THEN 'In progress'
                    WHEN (l_orderkey + l_suppkey) % 30 <= 14 THEN 'Completed on time'
                    ELSE 'Completed with a delay' END AS delivery_status
        FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) x JOIN orders ON l_orderkey = o_orderkey""",
    "delivery_details": """
        SELECT l_orderkey || '-' || l_suppkey AS delivery_id, l_partkey AS product_code,
               CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
        FROM lineitem GROUP BY 1, 2""",
    # derived reports other queries build on
    "status": """
        SELECT s.stock_date, p.product_name, w.warehouse_name, s.quantity_available
        FROM warehouse_stock s JOIN products p USING (product_code) JOIN warehouses w USING (warehouse_id)""",
    "short": """
        SELECT s.stock_date, p.product_name, s.quantity_available, p.safety_stock,
               p.safety_stock - s.quantity_available AS missing_quantity
        FROM warehouse_stock s JOIN products p USING (product_code)
        WHERE s.quantity_available < p.safety_stock""",
    "sales_lines": """
        SELECT o.order_date, p.product_name, d.quantity
        FROM order_details d JOIN inv_orders o USING (order_id) JOIN products p USING (product_code)""",
    "partner_deliveries": """
        SELECT d.*, s.supplier_name FROM deliveries d JOIN suppliers s USING (supplier_id)""",
    "partner_orders": """
        SELECT o.*, c.customer_name FROM inv_orders o JOIN customers c USING (customer_id)""",
    "sync_target": """
        SELECT * FROM inv_orders WHERE order_date <= DATE '2000-12-31'
        UNION ALL
        SELECT order_id, customer_id, order_date, expected_shipping_date, shipping_date,
               'In progress' AS shipping_status, sales_channel
        FROM inv_orders WHERE order_date <= DATE '2000-12-31' AND sales_channel = '1-URGENT'""",
    "sync_source": """
        SELECT order_id, customer_id, order_date, expected_shipping_date, shipping_date, shipping_status,
               lower(sales_channel) AS sales_channel
        FROM inv_orders WHERE order_date >= DATE '1996-01-01'""",
}


def _uses(sql: str) -> list[str]:
    return [name for name in CTES if re.search(rf"\b{name}\b", sql)]


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the expressions it needs, in dependency order."""
    needed: set[str] = set()
    todo = _uses(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [n for n in _uses(CTES[name]) if n != name]
    clauses = ",\n".join(f"{name} AS ({CTES[name].strip()})" for name in CTES if name in needed)
    return f"WITH {clauses}\n{sql.strip()}" if clauses else sql.strip()


def _band(value: str, limits: tuple[int, int, int, int], colours: tuple[str, str, str]) -> str:
    whens = " ".join(
        f"WHEN {value} >= {low} AND {value} < {high} THEN '{colour}'"
        for low, high, colour in zip(limits, limits[1:], colours))
    return f"CASE {whens} ELSE '{colours[-1]}' END"


def _fill(where: str) -> str:
    return f"""
        SELECT warehouse_name, fill_percentage,
               {_band('fill_percentage', (0, 50, 90, 100), ('green', 'orange', 'red'))} AS band
        FROM (SELECT w.warehouse_name,
                     CAST(ROUND(CAST(CAST(SUM(p.unit_volume * s.quantity_available) AS DOUBLE)
                          / NULLIF(w.capacity, 0) * 100 AS DECIMAL(38,12)), 2) AS DOUBLE) AS fill_percentage
              FROM warehouses w JOIN warehouse_stock s USING (warehouse_id) JOIN products p USING (product_code)
              WHERE {where}
              GROUP BY w.warehouse_name, w.capacity) t"""


def _abc(where: str, grain: str) -> str:
    """The naive form: a window ordered over all rows."""
    rows = {
        "line": f"""SELECT product_name, SUM(quantity) OVER (PARTITION BY product_name) AS total
                    FROM sales_lines WHERE {where}""",
        "product": f"SELECT product_name, SUM(quantity) AS total FROM sales_lines WHERE {where} GROUP BY 1",
    }[grain]
    return f"""
        (SELECT product_name, total, cum, g,
                CASE WHEN cum <= 0 OR cum > g THEN NULL
                     WHEN cum * 100 <= 20 * g THEN 'A' WHEN cum * 100 <= 50 * g THEN 'B' ELSE 'C' END AS abc_category
         FROM (SELECT product_name, total, SUM(total) OVER () AS g,
                      SUM(total) OVER (ORDER BY total DESC, product_name ROWS UNBOUNDED PRECEDING) AS cum
               FROM ({rows}) r) c)"""


def _abc_report(where: str, grain: str) -> str:
    return f"""
        SELECT product_name, CAST(total AS BIGINT) AS total_sales,
               CAST(total AS DOUBLE) / CAST(g AS DOUBLE) * 100 AS sales_pct,
               CAST(cum AS DOUBLE) / CAST(g AS DOUBLE) * 100 AS cumulative_pct, abc_category
        FROM {_abc(where, grain)} a"""


def _abc_summary(where: str, grain: str) -> str:
    return f"""
        SELECT COUNT(*) FILTER (WHERE abc_category = 'A') AS n_a,
               COUNT(*) FILTER (WHERE abc_category = 'B') AS n_b,
               COUNT(*) FILTER (WHERE abc_category = 'C') AS n_c,
               COUNT(abc_category) AS n_total, CAST(SUM(total) AS DOUBLE) AS total_sales
        FROM {_abc(where, grain)} a"""


def _abc_distribution(where: str, grain: str) -> str:
    return f"""
        SELECT l.abc_category,
               CAST(COUNT(a.abc_category) AS DOUBLE) / SUM(COUNT(a.abc_category)) OVER () * 100 AS pct
        FROM (VALUES ('A'), ('B'), ('C')) l(abc_category) LEFT JOIN {_abc(where, grain)} a USING (abc_category)
        GROUP BY l.abc_category"""


def _on_time(rows: str, status: str) -> str:
    return f"""
        SELECT pct_on_time, {_band('pct_on_time', (0, 50, 75, 100), ('red', 'orange', 'green'))} AS band
        FROM (SELECT AVG(CASE WHEN {status} = 'Completed on time' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100
                     AS pct_on_time FROM {rows}) t"""


def _top(role: str, name: str, value: str, rows: str, order: str) -> str:
    return f"(SELECT '{role}' AS role, {name}, {value} FROM {rows} ORDER BY {order}, {name} LIMIT 1)"


def _extremes(rows: str, name: str, status: str) -> str:
    def counts(text: str) -> str:
        return f"(SELECT {name}, COUNT(*) AS n FROM {rows} WHERE {status} = '{text}' GROUP BY 1) t"

    return (_top("best", name, "n", counts("Completed on time"), "n DESC") + " UNION ALL "
            + _top("worst", name, "n", counts("Completed with a delay"), "n DESC"))


def _lead_time(rows: str, key: str, name: str, actual: str) -> str:
    return f"""
        SELECT {key}, {name}, order_date, {actual},
               CAST(date_diff('day', order_date, {actual}) AS DOUBLE) AS lead_time_days,
               CAST(date_diff('day', order_date, {actual}) AS INTEGER) AS cycle_lead_time
        FROM {rows}"""


def _lead_avg(rows: str, actual: str) -> str:
    days = f"AVG(date_diff('day', order_date, {actual}))"
    return f"SELECT {days} AS avg_days, {days} * 24 AS avg_hours FROM {rows}"


def _speed(rows: str, name: str, actual: str) -> str:
    means = f"""(SELECT {name}, AVG(date_diff('day', order_date, {actual})) AS avg_days
                 FROM {rows} GROUP BY 1 HAVING COUNT({actual}) > 0) t"""
    return (_top("fastest", name, "avg_days", means, "avg_days") + " UNION ALL "
            + _top("slowest", name, "avg_days", means, "avg_days DESC"))


_DEDUPED = """
    (SELECT order_id, customer_id, order_date, expected_shipping_date, shipping_date, shipping_status, sales_channel
     FROM (SELECT *, ROW_NUMBER() OVER (
               PARTITION BY order_id
               ORDER BY customer_id NULLS FIRST, order_date NULLS FIRST, expected_shipping_date NULLS FIRST,
                        shipping_date NULLS FIRST, shipping_status NULLS FIRST, sales_channel NULLS FIRST) AS rn
           FROM sync_target) n WHERE rn = 1)"""

_INTEGRITY_RULES: list[tuple[str, list[str], list[str], list[tuple[str, str, str]]]] = [
    # table, key, other NOT NULL columns, (column, parent, parent column)
    ("suppliers", ["supplier_id"], ["supplier_name"], []),
    ("products", ["product_code"], ["product_name"], []),
    ("warehouses", ["warehouse_id"], ["warehouse_name"], []),
    ("warehouse_stock", ["stock_date", "product_code", "warehouse_id"], [],
     [("product_code", "products", "product_code"), ("warehouse_id", "warehouses", "warehouse_id")]),
    ("customers", ["customer_id"], ["customer_name"], []),
    ("inv_orders", ["order_id"], [], [("customer_id", "customers", "customer_id")]),
    ("order_details", [], [],
     [("order_id", "inv_orders", "order_id"), ("product_code", "products", "product_code")]),
    ("deliveries", ["delivery_id"], [], [("supplier_id", "suppliers", "supplier_id")]),
    ("delivery_details", ["delivery_id", "product_code"], [],
     [("delivery_id", "deliveries", "delivery_id"), ("product_code", "products", "product_code")]),
]


def _integrity() -> str:
    checks = []
    for view, key, not_null, fks in _INTEGRITY_RULES:
        table = "orders" if view == "inv_orders" else view
        for column in key + not_null:
            checks.append(f"""SELECT '{table}' AS "table", 'not_null' AS rule, '{column}' AS "column",
                              COUNT(*) FILTER (WHERE {column} IS NULL) AS violations FROM {view}""")
        if key:
            keys = ", ".join(key)
            known = " AND ".join(f"{c} IS NOT NULL" for c in key)
            checks.append(f"""SELECT '{table}', 'primary_key', '{",".join(key)}',
                              CAST(COALESCE(SUM(n - 1), 0) AS BIGINT)
                              FROM (SELECT COUNT(*) AS n FROM {view} WHERE {known} GROUP BY {keys}) k""")
        for column, parent, parent_column in fks:
            checks.append(f"""SELECT '{table}', 'foreign_key', '{column}', COUNT(*) FROM {view} c
                              WHERE c.{column} IS NOT NULL
                              AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_column} = c.{column})""")
    return "\nUNION ALL\n".join(checks)


_TABLES = [view for view, *_ in _INTEGRITY_RULES]
_LATEST_STOCK = "(SELECT MAX(stock_date) FROM warehouse_stock)"
_LATEST_SHORT = "(SELECT MAX(stock_date) FROM short)"
_YEAR = "order_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
_ANY = "order_date IS NOT NULL"
_DELIVERY = "delivery_id, supplier_name, order_date, expected_delivery_date, delivery_date, delivery_status"
_SHIPPING = "order_id, customer_name, order_date, expected_shipping_date, shipping_date, shipping_status"

_QUERIES: dict[str, str] = {
    "fill_levels": _fill(f"s.stock_date = {_LATEST_STOCK}"),
    "fill_levels_chosen": _fill(
        "s.stock_date = DATE '1998-03-01' AND w.warehouse_name IN ('NATION_0', 'NATION_3', 'NATION_24')"),
    "stock_dates": "SELECT DISTINCT stock_date FROM warehouse_stock",
    "warehouse_choices": "SELECT DISTINCT warehouse_name FROM warehouses",
    "status_choices": "SELECT DISTINCT delivery_status FROM partner_deliveries",
    "shipping_status_choices": "SELECT DISTINCT shipping_status FROM partner_orders",
    "delivery_date_bounds":
        "SELECT MIN(order_date) AS min_date, MAX(order_date) AS max_date FROM partner_deliveries",
    "shipping_date_bounds":
        "SELECT MIN(order_date) AS min_date, MAX(order_date) AS max_date FROM partner_orders",
    "sales_date_bounds": "SELECT MIN(order_date) AS min_date, MAX(order_date) AS max_date FROM sales_lines",
    "stock_status": "SELECT * FROM status",
    "stock_status_latest": f"SELECT * FROM status WHERE stock_date = {_LATEST_STOCK}",
    "stock_status_filtered": """
        SELECT * FROM status WHERE stock_date IN (DATE '1997-05-01', DATE '1999-11-01')
        AND warehouse_name IN ('NATION_1', 'NATION_7') AND product_name ILIKE '%RI_G%'""",
    "stock_totals_by_date": """
        SELECT stock_date, CAST(SUM(quantity_available) AS BIGINT) AS total_available FROM status GROUP BY 1""",
    "stock_totals_filtered": """
        SELECT d.stock_date, CAST(COALESCE(SUM(quantity_available), 0) AS BIGINT) AS total_available
        FROM (VALUES (DATE '1980-01-01'), (DATE '1998-06-01'), (DATE '1999-07-01')) d(stock_date)
        LEFT JOIN (SELECT * FROM status WHERE product_name ILIKE '%ring%' AND warehouse_name = 'NATION_2') s
        USING (stock_date) GROUP BY 1""",
    "stock_trend": """
        SELECT s.stock_date, w.warehouse_name, CAST(SUM(s.quantity_available) AS BIGINT) AS quantity_available
        FROM warehouse_stock s JOIN warehouses w USING (warehouse_id) WHERE EXISTS (SELECT 1 FROM status)
        GROUP BY 1, 2""",
    "stock_trend_filtered": """
        SELECT s.stock_date, w.warehouse_name, CAST(SUM(s.quantity_available) AS BIGINT) AS quantity_available
        FROM warehouse_stock s JOIN warehouses w USING (warehouse_id)
        WHERE s.stock_date IN (DATE '1997-05-01', DATE '1999-11-01')
          AND w.warehouse_name IN ('NATION_1', 'NATION_7')
          AND EXISTS (SELECT 1 FROM status WHERE stock_date IN (DATE '1997-05-01', DATE '1999-11-01')
                      AND warehouse_name IN ('NATION_1', 'NATION_7') AND product_name ILIKE '%plate%')
        GROUP BY 1, 2""",
    "shortage_dates": "SELECT DISTINCT stock_date FROM short",
    "shortages": "SELECT * FROM short",
    "shortages_latest": f"SELECT * FROM short WHERE stock_date = {_LATEST_SHORT}",
    "shortages_regex": """
        SELECT * FROM short WHERE regexp_matches(product_name, '^(RED|old) .*(ring|bolt)$', 'i')""",
    "shortage_totals_by_date": """
        SELECT stock_date, CAST(SUM(ABS(quantity_available - safety_stock)) AS BIGINT) AS shortage
        FROM short GROUP BY 1""",
    "shortage_bars": """
        SELECT stock_date, CAST(SUM(quantity_available) AS BIGINT) AS available_sum,
               CAST(SUM(ABS(quantity_available - safety_stock)) AS BIGINT) AS shortage_sum
        FROM short GROUP BY 1""",
    "abc_report": _abc_report(_ANY, "line"),
    "abc_report_range": _abc_report(_YEAR, "line"),
    "abc_report_product": _abc_report(_ANY, "product"),
    "abc_summary": _abc_summary(_ANY, "line"),
    "abc_summary_product": _abc_summary(_ANY, "product"),
    "abc_distribution": _abc_distribution(_ANY, "line"),
    "abc_top_product": """
        SELECT product_name, CAST(SUM(quantity) AS BIGINT) AS total_sales FROM sales_lines
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    "delivery_timeliness": f"SELECT {_DELIVERY} FROM partner_deliveries",
    "delivery_timeliness_late": f"""
        SELECT {_DELIVERY} FROM partner_deliveries WHERE {_YEAR} AND delivery_status = 'Completed with a delay'""",
    "shipping_timeliness": f"SELECT {_SHIPPING} FROM partner_orders",
    "delivery_on_time": _on_time("partner_deliveries", "delivery_status"),
    "shipping_on_time": _on_time("partner_orders", "shipping_status"),
    "supplier_extremes": _extremes("partner_deliveries", "supplier_name", "delivery_status"),
    "customer_extremes": _extremes("partner_orders", "customer_name", "shipping_status"),
    "delivery_lead_time": _lead_time("partner_deliveries", "delivery_id", "supplier_name", "delivery_date"),
    "shipping_lead_time": _lead_time("partner_orders", "order_id", "customer_name", "shipping_date"),
    "delivery_lead_time_avg": _lead_avg("partner_deliveries", "delivery_date"),
    "shipping_lead_time_avg": _lead_avg("partner_orders", "shipping_date"),
    "supplier_speed": _speed("partner_deliveries", "supplier_name", "delivery_date"),
    "customer_speed": _speed("partner_orders", "customer_name", "shipping_date"),
    "snapshot_sync": f"""
        SELECT * FROM {_DEDUPED} t WHERE order_id IN (SELECT order_id FROM sync_source)
        UNION ALL
        SELECT * FROM sync_source WHERE order_id NOT IN (SELECT order_id FROM sync_target)""",
    "dedup_first": f"SELECT * FROM {_DEDUPED} t",
    "snapshot_first_load": """
        SELECT * FROM sync_target
        UNION ALL
        SELECT * FROM sync_source WHERE order_id NOT IN (SELECT order_id FROM sync_target)""",
    "snapshot_sync_summary": """
        SELECT 'orders' AS "table",
               (SELECT COUNT(*) - COUNT(DISTINCT order_id) FROM sync_target) AS duplicates_removed,
               (SELECT COUNT(*) FROM sync_source WHERE order_id NOT IN (SELECT order_id FROM sync_target)) AS added,
               (SELECT COUNT(*) FROM sync_target WHERE order_id NOT IN (SELECT order_id FROM sync_source)) AS deleted,
               'synced' AS status""",
    "integrity_checks": _integrity(),
    "table_catalog": "\nUNION ALL\n".join(
        f"SELECT 'inv_{'orders' if t == 'inv_orders' else t}' AS table_name, COUNT(*) AS row_count FROM {t}"
        for t in _TABLES),
    "bound_parameter_sql": """
        SELECT s.stock_date, w.warehouse_name, COUNT(*) AS row_count,
               CAST(SUM(s.quantity_on_hand) AS BIGINT) AS quantity_on_hand
        FROM warehouse_stock s JOIN warehouses w USING (warehouse_id)
        WHERE w.warehouse_name IN ('NATION_4', 'NATION_5') GROUP BY 1, 2""",
    "browse_table": "SELECT * FROM inv_orders",
}


_SOME = "order_date BETWEEN DATE '1995-03-10' AND DATE '1998-08-20'"
_CHOSEN_STOCK = """(SELECT * FROM status
        WHERE stock_date IN (SELECT CAST(date_trunc('month', order_date) AS DATE) FROM deliveries WHERE supplier_id = 3)
          AND warehouse_name IN (SELECT warehouse_name FROM warehouses WHERE capacity >= 3000))"""
_BAD = "(order_id % 47 = 0 OR order_id % 41 = 0 OR order_id % 43 = 0)"


def _percent_text(value: str) -> str:
    return f"CAST(round_even({value} * 100, 0) / 100 AS VARCHAR) || '%'"


def _seconds(hours: str) -> str:
    return f"CAST({hours} AS DOUBLE) * 3600"


_QUERIES |= {
    "abc_report_stored": _abc_report(_SOME, "line"),
    "abc_report_product_stored": _abc_report(_ANY, "product"),
    "abc_summary_stored": _abc_summary(_SOME, "line"),
    "abc_distribution_stored": _abc_distribution(_ANY, "line"),
    "abc_top_product_stored": _QUERIES["abc_top_product"],
    "snapshot_sync_buckets": _QUERIES["snapshot_sync"],
    "stored_row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}"
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "stored_date_bounds": """
        SELECT 'orders' AS table_name, MIN(order_date) AS min_value, MAX(order_date) AS max_value FROM inv_orders
        UNION ALL
        SELECT 'warehouse_stock', MIN(stock_date), MAX(stock_date) FROM warehouse_stock""",
    "stock_status_choices": f"SELECT * FROM {_CHOSEN_STOCK} t",
    "stock_totals_choices": f"""
        SELECT d.stock_date, CAST(COALESCE(SUM(quantity_available), 0) AS BIGINT) AS total_available
        FROM (SELECT DISTINCT CAST(date_trunc('month', order_date) AS DATE) AS stock_date
              FROM deliveries WHERE supplier_id = 3) d
        LEFT JOIN (SELECT * FROM {_CHOSEN_STOCK} t WHERE product_name ILIKE '%ring%') s USING (stock_date) GROUP BY 1""",
    "ingest_accepted": f"SELECT * FROM inv_orders WHERE NOT {_BAD}",
    "ingest_rejected": """
        SELECT 'orders' AS "table", CAST(order_id AS VARCHAR) AS row_key, c AS "column", t AS text
        FROM (SELECT order_id, 'customer_id' AS c, 'no. ' || customer_id AS t FROM inv_orders WHERE order_id % 47 = 0
              UNION ALL SELECT order_id, 'order_date', 'soon' FROM inv_orders WHERE order_id % 41 = 0
              UNION ALL SELECT order_id, 'shipping_date', '2024-13-45' FROM inv_orders WHERE order_id % 43 = 0) x""",
    "refresh_from_files": """
        SELECT 'orders' AS "table", CAST(0 AS BIGINT) AS duplicates_removed,
               COUNT(*) FILTER (WHERE order_date > DATE '1998-06-30') AS added,
               COUNT(*) FILTER (WHERE order_date < DATE '1993-01-01') AS deleted, 'synced' AS status FROM inv_orders
        UNION ALL SELECT 'suppliers', 0, 0, 0, 'synced' UNION ALL SELECT 'customers', 0, 0, 0, 'synced'
        UNION ALL SELECT 'products', 0, 0, 0, 'skipped'""",
    "report_export": f"""
        SELECT product_name AS "Product Name", CAST(total_sales AS VARCHAR) AS "Total Sales",
               {_percent_text('sales_pct')} AS "Sales Percentage",
               {_percent_text('cumulative_pct')} AS "Cumulative Percentage", abc_category AS "ABC Category"
        FROM ({_abc_report(_ANY, "product")}) r""",
    "appended_orders": """
        SELECT CAST(date_trunc('month', order_date) AS DATE) AS order_month, COUNT(*) AS n FROM inv_orders GROUP BY 1""",
    "write_checks": """
        SELECT 'customers' AS "table", 'not_null' AS rule, 'customer_id' AS "column", CAST(0 AS BIGINT) AS violations
        UNION ALL SELECT 'customers', 'not_null', 'customer_name', COUNT(*) FROM customers WHERE customer_id % 10 = 3
        UNION ALL SELECT 'customers', 'row_count', '', COUNT(*) FROM customers
        UNION ALL SELECT 'products', 'not_null', c, 0 FROM (VALUES ('product_code'), ('product_name')) v(c)
        UNION ALL SELECT 'products', 'row_count', '', COUNT(*) FROM products""",
    "lead_time_with_hours": f"""
        SELECT order_id,
               CAST(date_diff('day', order_date, shipping_date) AS DOUBLE)
                   + ({_seconds('order_id * 7 % 24')} - {_seconds('order_id % 24')}) / 86400 AS lead_time_days,
               CAST(date_diff('day', order_date, shipping_date) AS INTEGER) AS cycle_lead_time
        FROM partner_orders""",
    "lead_time_text": """
        SELECT printf('%.2f', d) || ' (days)' AS avg_days, printf('%.2f', d * 24) || ' (hours)' AS avg_hours
        FROM (SELECT AVG(date_diff('day', order_date, delivery_date)) AS d FROM partner_deliveries) t""",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(sql) for name, sql in _QUERIES.items()}
