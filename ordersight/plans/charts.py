"""Chart-ready tables (S18, Q36): ordered label -> value rows.

Drawing is not built; these are the small inputs a plotting layer needs, with
an explicit plot order.  Every window here runs over a result of at most a few
tens of rows (a top-k or a fixed label list).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions.columns import (
    DELAY_BUCKETS,
    FREIGHT_SHORT,
    REVIEW_GROUPS,
    label_ordinal,
    rate_pct,
    tercile_label,
)


def delivery_chart(delay_table: DataFrame) -> DataFrame:
    """Low-review rate per delay bucket in bucket order."""
    return delay_table.select(
        label_ordinal("delivery_bucket", DELAY_BUCKETS).alias("plot_order"), "delivery_bucket", "low_review_rate_pct"
    ).orderBy("plot_order")


def category_chart(category_table: DataFrame) -> DataFrame:
    """Top categories re-sorted ascending for a horizontal bar chart."""
    w = Window.orderBy(F.asc("low_review_rate_pct"), F.asc("category"))
    return category_table.select(
        F.row_number().over(w).alias("plot_order"), "category", "low_review_rate_pct"
    ).orderBy("plot_order")


def repeat_chart(repeat_table: DataFrame) -> DataFrame:
    """Repeat-purchase rate per labelled first-review group, in label order."""
    g = "first_order_review_group"
    return (
        repeat_table.where(F.col(g).isNotNull())
        .select(label_ordinal(g, REVIEW_GROUPS).alias("plot_order"), g, "repeat_purchase_rate_pct")
        .orderBy("plot_order")
    )


def seller_chart(seller_table: DataFrame) -> DataFrame:
    """Sellers ranked by low-review rate with labels '#k (first 8 chars...)', plotted ascending.

    Ranks follow the published (rounded) rates; ties fall back to the late rate
    and then the seller id, so every label is deterministic.
    """
    rank_w = Window.orderBy(F.desc("low_review_rate_pct"), F.desc("late_delivery_rate_pct"), F.asc("seller_id"))
    ranked = seller_table.withColumn("seller_rank", F.row_number().over(rank_w))
    label = F.concat(
        F.lit("#"),
        F.col("seller_rank").cast("string"),
        F.lit(" ("),
        F.substring(F.col("seller_id").cast("string"), 1, 8),
        F.lit("…)"),
    )
    return ranked.select(
        "seller_rank",
        "seller_id",
        label.alias("seller_label"),
        "low_review_rate_pct",
    ).orderBy(F.desc("seller_rank"))


def freight_chart(tercile_counts: DataFrame) -> DataFrame:
    """Low-review rate per qcut freight-ratio tercile (Low / Mid / High)."""
    return tercile_counts.select(
        F.col("freight_ratio_tercile").alias("plot_order"),
        tercile_label("freight_ratio_tercile", FREIGHT_SHORT).alias("freight_ratio_bucket"),
        rate_pct("low_orders", "orders").alias("low_review_rate_pct"),
    ).orderBy("plot_order")
