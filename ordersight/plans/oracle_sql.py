"""Independent SQL formulation of every analysis, for DuckDB.

Each statement rebuilds the raw tables from the driver tables with the same
section 2 (ids such as Q10 or J4 in the comments): items and reviews stacked and folded once
per order, customers as ordered histories, items unfolded over the scores of their order.
It is a cross-check of the Spark plans, not used by them.

Rounding uses the same exact half-up forms as the Spark side:
``floor((2*10^d*num + den) / (2*den)) / 10^d``.
"""

from __future__ import annotations

CUTOFF = "2000-07-01"
MIN_STATE_ORDERS = 200
MIN_CATEGORY_ROWS = 100
MIN_SELLER_ORDERS = 50
MIN_SELLER_ON_TIME = 30
MIN_STRATUM_N = 20

ADAPTER = """
li_first_ship AS (
    SELECT l_orderkey, min(l_shipdate) AS ms FROM lineitem GROUP BY l_orderkey
),
o_gap AS (
    SELECT o.*, ((date_diff('day', o.o_orderdate::DATE, f.ms::DATE) % 36) + 36) % 36 AS gap
    FROM orders o LEFT JOIN li_first_ship f ON f.l_orderkey = o.o_orderkey
),
raw_orders_p AS (
    SELECT
        o_orderkey AS order_id,
        o_custkey * 20 + o_orderkey % 20 AS customer_id,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'shipped' ELSE 'delivered' END AS order_status,
        o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS order_purchase_timestamp,
        CASE WHEN o_orderkey % 97 = 0 OR gap IS NULL THEN CAST(NULL AS TIMESTAMP)
             ELSE o_orderdate + to_days(CAST(gap AS INTEGER))
                  + to_hours(CAST((o_orderkey * 7) % 24 AS INTEGER)) + to_minutes(30)
        END AS order_delivered_customer_date,
        o_orderdate + to_days(24) AS order_estimated_delivery_date,
        o_orderpriority
    FROM o_gap
),
raw_orders AS (
    SELECT order_id, customer_id, order_status, order_purchase_timestamp,
           order_delivered_customer_date, order_estimated_delivery_date
    FROM raw_orders_p
),
review_first AS (
    SELECT order_id,
           greatest(1, 1 + (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 3 + order_id) % 5
                       - CASE WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 2 ELSE 0 END) AS s1
    FROM raw_orders_p
    WHERE order_id % 101 <> 0
),
raw_order_reviews AS (
    SELECT 2 * order_id AS review_id, order_id, CAST(s1 AS INTEGER) AS review_score FROM review_first
    UNION ALL
    SELECT 2 * order_id + 1, order_id, CAST(least(5, s1 + 1) AS INTEGER) FROM review_first WHERE order_id % 50 = 0
),
raw_order_items AS (
    SELECT l_orderkey AS order_id, l_linenumber AS order_item_id,
           CASE WHEN l_partkey % 211 = 0 THEN -1 ELSE l_partkey END AS product_id,
           l_suppkey AS seller_id, l_shipdate AS shipping_limit_date,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
           CAST(CAST(l_quantity AS INTEGER) * 0.5 AS DECIMAL(12,2)) AS freight_value
    FROM lineitem
),
cust_k AS (
    SELECT c_custkey, c_nationkey, unnest(range(20)) AS k FROM customer
),
raw_customers AS (
    SELECT c_custkey * 20 + k AS customer_id, (c_custkey * 20 + k) // 2 AS customer_unique_id,
           n.n_name AS customer_state
    FROM cust_k JOIN nation n ON cust_k.c_nationkey = n.n_nationkey
),
raw_products AS (
    SELECT p_partkey AS product_id,
           NULLIF(CASE WHEN p_partkey % 61 = 0 THEN '' ELSE replace(lower(p_brand), 'brand#', 'cat_') END, '')
               AS product_category_name
    FROM part
),
raw_category_translation AS (
    SELECT DISTINCT replace(lower(p_brand), 'brand#', 'cat_') AS product_category_name,
           replace(replace(lower(p_brand), 'brand#', 'cat_'), 'cat_', 'category_') AS product_category_name_english
    FROM part WHERE p_brand <> 'Brand#13'
),
-- J3, F1: one label per product: translated name, else own name, else 'unknown'
product_label AS (
    SELECT product_id,
           coalesce((SELECT t.product_category_name_english FROM raw_category_translation t
                     WHERE t.product_category_name = p.product_category_name),
                    product_category_name, 'unknown') AS label
    FROM raw_products p
),
-- Q01: items and reviews of an order stacked as lines of one list
order_lines AS (
    SELECT order_id, order_item_id, seller_id, price, freight_value, coalesce(label, 'unknown') AS label,
           CAST(NULL AS INTEGER) AS score
    FROM raw_order_items LEFT JOIN product_label USING (product_id)
    UNION ALL
    SELECT order_id, NULL, NULL, NULL, NULL, NULL, review_score FROM raw_order_reviews
),
-- G1 - G8, G14: the list folded once
order_totals AS (
    SELECT order_id,
           nullif(count(label), 0) AS item_count,
           CASE WHEN count(label) > 0 THEN count(DISTINCT seller_id) END AS seller_count,
           CAST(sum(price) AS DECIMAL(38,2)) AS item_revenue,
           CAST(sum(freight_value) AS DECIMAL(38,2)) AS freight_revenue,
           CAST(sum(price) + sum(freight_value) AS DECIMAL(38,2)) AS order_gmv,
           array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ', ') AS categories,
           avg(score) AS review_score
    FROM order_lines GROUP BY order_id
),
-- P3, P4, F3: flags are NULL where their date or score is missing
mart_order_fact AS (
    SELECT order_id, customer_unique_id, customer_state, order_status, order_purchase_timestamp,
           order_delivered_customer_date, order_estimated_delivery_date, item_count, seller_count,
           item_revenue, freight_revenue, order_gmv, categories, review_score,
           CAST(order_delivered_customer_date::DATE - order_purchase_timestamp::DATE AS INTEGER) AS delivery_days,
           CAST(order_delivered_customer_date::DATE - order_estimated_delivery_date::DATE AS INTEGER) AS delivery_delay_days,
           CASE WHEN order_delivered_customer_date IS NOT NULL
                THEN CAST((order_delivered_customer_date > order_estimated_delivery_date) IS TRUE AS INTEGER) END AS is_late_delivery,
           CAST(review_score <= 2 AS INTEGER) AS is_low_review
    FROM raw_customers JOIN raw_orders USING (customer_id) LEFT JOIN order_totals USING (order_id)
),
dr AS (
    SELECT * FROM mart_order_fact WHERE order_status = 'delivered' AND review_score IS NOT NULL
)"""


def rr(num: str, den: str, d: int = 2) -> str:
    """Exact half-up rounding of num/den (NULL when den = 0)."""
    s = 10**d
    return (
        f"(CASE WHEN CAST({den} AS DOUBLE) = 0 THEN NULL ELSE "
        f"floor(({2 * s}.0 * CAST({num} AS DOUBLE) + CAST({den} AS DOUBLE)) / (2.0 * CAST({den} AS DOUBLE))) / {s}.0 END)"
    )


def rate(events: str, total: str, d: int = 2) -> str:
    return rr(f"(100.0 * CAST({events} AS DOUBLE))", total, d)


def flag_rate(flag: str) -> str:
    """ROUND(100*AVG(flag),2) ignoring NULL flags."""
    return rate(f"sum(CASE WHEN {flag} = 1 THEN 1 ELSE 0 END)", f"count({flag})")


def avg_score(score: str = "review_score") -> str:
    return rr(f"sum({score} * 2.0)", f"(count({score}) * 2)")


def rhu(x: str, d: int) -> str:
    """Half-up rounding of an inexact double."""
    s = 10**d
    return f"(floor(CAST({x} AS DOUBLE) * {s}.0 + 0.5) / {s}.0)"


def q(body: str) -> str:
    return f"WITH {ADAPTER},\n{body.strip()}"


def q_plain(body: str) -> str:
    """A query whose body starts with SELECT (no extra CTEs)."""
    return f"WITH {ADAPTER}\n{body.strip()}"


def chi2_ctes(cells: str) -> str:
    """CTEs computing Pearson chi-square (Yates when dof = 1) from ``cells(r, c, o)``.

    Textbook form: complete the r x k grid, E = R * C / N, sum (O - E)^2 / E.
    Produces ``{cells}_stat(n, nr, nc, dof, chi2, chi2_raw, cramers_v)``.
    """
    return f"""
{cells}_rt AS (SELECT r, sum(o) AS rt FROM {cells} GROUP BY r HAVING sum(o) > 0),
{cells}_ct AS (SELECT c, sum(o) AS ct FROM {cells} GROUP BY c HAVING sum(o) > 0),
{cells}_tot AS (SELECT sum(rt) AS n FROM {cells}_rt),
{cells}_grid AS (
    SELECT rt.r, ct.c, coalesce(x.o, 0) AS o, CAST(rt.rt AS DOUBLE) * ct.ct / tot.n AS e, tot.n
    FROM {cells}_rt rt JOIN {cells}_ct ct ON TRUE JOIN {cells}_tot tot ON TRUE
    LEFT JOIN {cells} x ON x.r = rt.r AND x.c = ct.c
),
{cells}_sums AS (
    SELECT max(n) AS n, count(DISTINCT r) AS nr, count(DISTINCT c) AS nc,
           sum(pow(o - e, 2) / e) AS chi2_raw,
           sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS chi2_yates
    FROM {cells}_grid
),
{cells}_stat AS (
    SELECT CAST(n AS BIGINT) AS n, nr, nc, CASE WHEN nr > 0 THEN CAST((nr - 1) * (nc - 1) AS INTEGER) END AS dof,
           CASE WHEN (nr - 1) * (nc - 1) = 1 THEN chi2_yates ELSE chi2_raw END AS chi2,
           chi2_raw, sqrt(chi2_raw / (n * (least(nr, nc) - 1))) AS cramers_v
    FROM {cells}_sums
)"""


def tail_ctes(tests: str, key: str) -> str:
    """CTE ``{tests}_p(key, p)``: P(X > x) for chi-square from ``tests(key, x, dof)``.

    With a = dof / 2 and y = x / 2 the lower tail is the sum over j of
    exp((a + j) ln y - y - lgamma(a + j + 1)).  All terms are positive and their mass lies
    around j = y - a, so 4,000 terms do for y <= 3,000; beyond, the upper tail of a
    test with few degrees of freedom is 0 to far more digits than are compared.
    """
    return f"""
{tests}_low AS (
    SELECT {key}, x, sum(exp((dof / 2.0 + j) * ln(greatest(x, 1e-300) / 2) - x / 2 - lgamma(dof / 2.0 + j + 1))) AS low
    FROM {tests}, range(0, 4000) terms(j) GROUP BY {key}, x, dof
),
{tests}_p AS (
    SELECT {key}, CASE WHEN x <= 0 THEN 1.0 WHEN x > 6000 THEN 0.0 WHEN x > 0 THEN greatest(0.0, 1.0 - low) END AS p
    FROM {tests}_low
)"""


def trend_ctes(levels: str) -> str:
    """Cochran-Armitage z from ``levels(t, x, m)`` (score, events, total)."""
    return f"""
{levels}_agg AS (
    SELECT sum(x * t) AS sxt, sum(m * t) AS snt, sum(m * t * t) AS sntt,
           CAST(sum(m) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS x
    FROM {levels}
),
{levels}_z AS (
    SELECT (sxt - (x / n) * snt) / sqrt((x / n) * (1 - x / n) * (sntt - snt * snt / n)) AS trend_z
    FROM {levels}_agg
)"""


def mh_ctes(strata: str) -> str:
    """Mantel-Haenszel statistic and pooled OR from ``strata(a, b, c, d)``."""
    return f"""
{strata}_d AS (SELECT CAST(a AS DOUBLE) a, CAST(b AS DOUBLE) b, CAST(c AS DOUBLE) c, CAST(d AS DOUBLE) d,
                      CAST(a + b + c + d AS DOUBLE) AS n FROM {strata}),
{strata}_mh AS (
    SELECT pow(sum(a - (a + b) * (a + c) / n), 2) / sum((a + b) * (a + c) * (b + d) * (c + d) / (n * n * (n - 1)))
               AS mh_statistic,
           sum(a * d / n) / sum(b * c / n) AS pooled_odds_ratio,
           count(*) AS strata
    FROM {strata}_d
)"""
