"""Item, item x review and order-seller grains.

The SQL analyses join items to reviews on ``order_id``, so an order with two
items and two reviews contributes four rows.  That fan-out is never
materialised here: reviews are first reduced to per-order sums
``(n_rev, s_rev, n_low)`` and items to per-(order, key) counts ``n_items``;
every item x review aggregate is then an exact weighted sum, e.g.

    COUNT(*)          = sum(n_items * n_rev)
    SUM(review_score) = sum(n_items * s_rev)
    SUM(is_low)       = sum(n_items * n_low)

so a hot order with many items and reviews costs one row per (order, key),
never n_items x n_rev rows.  All inputs of the joins are aggregated by
``order_id`` first (partial aggregation before the shuffle), which also makes
the joins one-to-one or many-to-one on the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.operators.categories import category_counts
from ordersight.operators.shared import shared


def _delivered():
    return F.col("order_status") == "delivered"


def order_review_stats(reviews: DataFrame) -> DataFrame:
    """Per order: number of scored reviews, score sum, low (<=2) count, mean score."""
    r = reviews.where(F.col("review_score").isNotNull())
    return (
        r.groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("n_rev"),
            F.sum("review_score").alias("s_rev"),
            F.count_if(F.col("review_score") <= 2).alias("n_low"),
        )
        .withColumn("mean_score", F.col("s_rev") / F.col("n_rev"))
    )


def delivered_orders_with_dates(orders: DataFrame, on_time_only: bool = False) -> DataFrame:
    """Delivered orders with both delivery dates; ``is_late`` 0/1."""
    d, e = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    o = orders.where(_delivered() & d.isNotNull() & e.isNotNull())
    if on_time_only:
        o = o.where(d <= e)
    return o.select("order_id", (d > e).cast("int").alias("is_late"))


def review_stats(raw: dict[str, DataFrame]) -> DataFrame:
    return shared(raw, "review_stats", lambda: order_review_stats(raw["order_reviews"]))


def category_item_review_totals(raw: dict[str, DataFrame], on_time_only: bool) -> DataFrame:
    """Item x review grain per category, without materialising the fan-out.

    Returns ``category, rows, score_sum, low_rows``.
    """
    if on_time_only:
        orders = delivered_orders_with_dates(raw["orders"], on_time_only=True).select("order_id")
    else:
        orders = raw["orders"].where(_delivered()).select("order_id")
    counts = category_counts(raw)
    rev = review_stats(raw)
    j = counts.join(orders, "order_id", "left_semi").join(rev, "order_id", "inner")
    return j.groupBy("category").agg(
        F.sum(F.col("n_items") * F.col("n_rev")).alias("rows"),
        F.sum(F.col("n_items") * F.col("s_rev")).alias("score_sum"),
        F.sum(F.col("n_items") * F.col("n_low")).alias("low_rows"),
    )


def seller_order_grain(raw: dict[str, DataFrame]) -> DataFrame:
    """One row per (seller, delivered order with dates): item count, smallest item id,
    lateness, review stats."""

    def build() -> DataFrame:
        items = raw["order_items"].groupBy("seller_id", "order_id").agg(
            F.count(F.lit(1)).alias("n_items"), F.min("order_item_id").alias("first_item_id")
        )
        orders = delivered_orders_with_dates(raw["orders"])
        return items.join(orders, "order_id", "inner").join(review_stats(raw), "order_id", "inner")

    return shared(raw, "seller_order_grain", build)


def on_time_item_grain(raw: dict[str, DataFrame]) -> DataFrame:
    """Pandas item grain (H9): on-time items with the per-order mean score and category.

    Items of unknown products are dropped; '' / missing categories read 'unknown'.
    """
    orders = delivered_orders_with_dates(raw["orders"], on_time_only=True).select("order_id")
    counts = category_counts(raw).where(~F.col("orphan"))
    rev = review_stats(raw).select(
        "order_id", "mean_score", (F.col("mean_score") <= 2).cast("int").alias("is_low_review")
    )
    return counts.join(orders, "order_id", "left_semi").join(rev, "order_id", "inner")
