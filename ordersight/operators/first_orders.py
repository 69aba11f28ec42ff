"""First delivered order and the next delivered order of every customer.

Reference semantics: ROW_NUMBER() and LEAD() over delivered orders of a
customer ordered by purchase time (``order_id`` added as the tie-break), then
``row_number = 1``.  Only the first two rows of each customer matter, so the
window is filtered with ``row_number <= 2``: Spark then plans a partial
``WindowGroupLimit`` before the shuffle, which caps what any one customer -
however many orders it holds - sends across the network at two rows per map
task.  The two rows are folded into one by an aggregate on the already
partitioned customer key (no second exchange).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions.columns import calendar_days, elapsed_days
from ordersight.operators.mart import delivered_orders
from ordersight.operators.shared import shared

CUSTOMER = "customer_unique_id"
TS = "order_purchase_timestamp"


def first_two_orders(mart: DataFrame, carry: tuple[str, ...] = ("review_score", "is_late_delivery")) -> DataFrame:
    """One row per customer: first delivered order (+ ``carry`` columns) and the next one."""
    d = delivered_orders(mart).select(CUSTOMER, "order_id", TS, *carry)
    w = Window.partitionBy(CUSTOMER).orderBy(F.col(TS).asc_nulls_first(), F.col("order_id").asc())
    top2 = d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)
    first = F.struct(F.col("order_id"), F.col(TS), *[F.col(c) for c in carry])
    nxt = F.struct(F.col("order_id").alias("next_order_id"), F.col(TS).alias("next_order_purchase_timestamp"))
    folded = top2.groupBy(CUSTOMER).agg(
        F.max(F.when(F.col("_rn") == 1, first)).alias("_f"),
        F.max(F.when(F.col("_rn") == 2, nxt)).alias("_n"),
    )
    return folded.select(
        CUSTOMER,
        "_f.*",
        F.col("_n.next_order_id").alias("next_order_id"),
        F.col("_n.next_order_purchase_timestamp").alias("next_order_purchase_timestamp"),
    )


def first_reviewed_orders(mart: DataFrame, cutoff: str) -> DataFrame:
    """Customers whose first delivered order is reviewed and placed before ``cutoff``.

    The review and cut-off filters are applied after the window on purpose: an
    unreviewed first order disqualifies the customer, it does not promote the
    second order.
    """
    f = shared(mart, "first_two_orders", lambda: first_two_orders(mart))
    cut = F.lit(cutoff).cast("timestamp_ntz")
    f = f.where(F.col("review_score").isNotNull() & (F.col(TS) < cut))
    has_next = F.col("next_order_id").isNotNull()
    return f.select(
        "*",
        has_next.cast("int").alias("has_repeat"),
        F.when(has_next, calendar_days("next_order_purchase_timestamp", TS)).alias("days_to_next_order"),
        F.when(has_next, elapsed_days("next_order_purchase_timestamp", TS)).alias("elapsed_days_to_next_order"),
    )
