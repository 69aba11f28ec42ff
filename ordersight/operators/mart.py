"""Order-level fact table (Q01) and the shared populations.

Plan shape (one row per order):

    order_items groupBy(order_id): counts, distinct sellers (via a partial
        (order, seller) aggregate), money sums      -- no product lookup
    category grain (order, category, orphan)        -- the one item -> product
        groupBy(order_id): sorted distinct list        join, shared with the
                                                       category analyses
    order_reviews groupBy(order_id): avg score
    orders left-join the three on order_id          -- sides already hashed on order_id
    inner-join customers on customer_id

Every side meeting the orders is pre-aggregated to one row per order, so the
joins are one-to-one and the fact table never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions.columns import calendar_days, late_flag, low_review_flag
from ordersight.operators.categories import category_counts
from ordersight.operators.skew import salted_join
from ordersight.schemas import MART_COLUMNS

MONEY_SUM = "decimal(38,2)"


def order_item_aggregates(items: DataFrame) -> DataFrame:
    """Per order: item count, distinct sellers, money sums (no product lookup needed)."""
    return items.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_distinct("seller_id").alias("seller_count"),
        F.sum("price").cast(MONEY_SUM).alias("item_revenue"),
        F.sum("freight_value").cast(MONEY_SUM).alias("freight_revenue"),
        F.sum(F.col("price") + F.col("freight_value")).cast(MONEY_SUM).alias("order_gmv"),
    )


def order_category_lists(counts: DataFrame) -> DataFrame:
    """Per order: sorted distinct categories joined by ', ' (from the category grain)."""
    return counts.groupBy("order_id").agg(
        F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories")
    )


def order_review_aggregates(reviews: DataFrame) -> DataFrame:
    """Mean score per order; several reviews per order are legal."""
    return reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))


def build_mart(raw: dict[str, DataFrame], isolate_hot: bool = False) -> DataFrame:
    """``mart_order_fact``: the 18-column order-level fact table.

    With ``isolate_hot`` heavy products and customers are dealt over several tasks of
    their joins (``operators.skew``) instead of leaving them to skew-join splitting alone.
    """
    orders = raw["orders"]
    item_agg = order_item_aggregates(raw["order_items"])
    category_agg = order_category_lists(category_counts(raw, isolate_hot))
    review_agg = order_review_aggregates(raw["order_reviews"])
    customers = raw["customers"].select("customer_id", "customer_unique_id", "customer_state")

    joined = (
        orders.join(item_agg, "order_id", "left")
        .join(category_agg, "order_id", "left")
        .join(review_agg, "order_id", "left")
    )
    if isolate_hot:
        joined = salted_join(joined, customers, "customer_id", "order_id", "inner", keys_from=orders)
    else:
        joined = joined.join(customers, "customer_id", "inner")
    delivered = F.col("order_delivered_customer_date")
    return joined.select(
        *MART_COLUMNS[:14],
        calendar_days(delivered, "order_purchase_timestamp").alias("delivery_days"),
        calendar_days(delivered, "order_estimated_delivery_date").alias("delivery_delay_days"),
        late_flag(delivered, "order_estimated_delivery_date").alias("is_late_delivery"),
        low_review_flag("review_score").alias("is_low_review"),
    )


def delivered_orders(mart: DataFrame) -> DataFrame:
    return mart.where(F.col("order_status") == "delivered")


def delivered_reviewed(mart: DataFrame) -> DataFrame:
    """Population of most analyses: delivered orders with a review score."""
    return mart.where((F.col("order_status") == "delivered") & F.col("review_score").isNotNull())
