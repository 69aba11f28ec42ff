"""Category and seller risk tables.

SQL versions work at the item x review grain (computed from per-order sums,
see ``operators.grains``); the pandas versions at the item grain with the
per-order mean score, and at the order-seller grain.  Every top-k ends with a
unique tie-break so the ``limit`` is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions.columns import rate_pct, round_ratio
from ordersight.operators.grains import (
    category_item_review_totals,
    on_time_item_grain,
    seller_order_grain,
)


def _category_table(raw: dict[str, DataFrame], on_time_only: bool, count_name: str, min_rows: int, top: int):
    t = category_item_review_totals(raw, on_time_only).where(F.col("rows") >= min_rows)
    out = t.select(
        "category",
        F.col("rows").alias(count_name),
        round_ratio("score_sum", "rows", 2).alias("avg_review_score"),
        rate_pct("low_rows", "rows").alias("low_review_rate_pct"),
    )
    return out.orderBy(F.desc("low_review_rate_pct"), F.desc(count_name), F.asc("category")).limit(top)


def category_risk(raw: dict[str, DataFrame], min_rows: int = 100, top: int = 15) -> DataFrame:
    """Q10: categories by low-review rate at the item x review grain."""
    return _category_table(raw, False, "items_in_reviewed_orders", min_rows, top)


def category_on_time_risk(raw: dict[str, DataFrame], min_rows: int = 100, top: int = 15) -> DataFrame:
    """Q19 (H9): the same restricted to on-time deliveries."""
    return _category_table(raw, True, "items_in_on_time_reviewed_orders", min_rows, top)


def category_on_time_item_totals(raw: dict[str, DataFrame]) -> DataFrame:
    """Per category at the item grain: items, twice the mean-score sum, low items."""
    g = on_time_item_grain(raw)
    return g.groupBy("category").agg(
        F.sum("n_items").alias("items"),
        F.sum(F.col("n_items") * F.col("mean_score") * F.lit(2.0)).alias("score_sum_x2"),
        F.sum(F.col("n_items") * F.col("is_low_review")).alias("low_items"),
    )


def category_on_time_risk_item(raw: dict[str, DataFrame], min_items: int = 100, top: int = 15) -> DataFrame:
    """Item grain with the per-order mean score; sorted on the unrounded rate."""
    t = category_on_time_item_totals(raw).where(F.col("items") >= min_items)
    t = t.withColumn("_rate", F.col("low_items") / F.col("items"))
    top_rows = t.orderBy(F.desc("_rate"), F.desc("items"), F.asc("category")).limit(top)
    return top_rows.select(
        "category",
        F.col("items").alias("items_in_on_time_reviewed_orders"),
        round_ratio("score_sum_x2", F.col("items") * 2, 2).alias("avg_review_score"),
        rate_pct("low_items", "items").alias("low_review_rate_pct"),
    )


def _seller_item_review_totals(raw: dict[str, DataFrame]) -> DataFrame:
    """Item x review grain per seller (two-level aggregation, X3)."""
    so = seller_order_grain(raw)
    w = F.col("n_items") * F.col("n_rev")
    on_time = F.col("is_late") == 0
    return so.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("delivered_orders"),
        F.count_if(on_time).alias("on_time_orders"),
        F.sum(w).alias("rows"),
        F.sum(F.col("n_items") * F.col("s_rev")).alias("score_sum"),
        F.sum(F.col("n_items") * F.col("n_low")).alias("low_rows"),
        F.sum(w * F.col("is_late")).alias("late_rows"),
        F.sum(F.when(on_time, w)).alias("on_time_rows"),
        F.sum(F.when(on_time, F.col("n_items") * F.col("n_low"))).alias("on_time_low_rows"),
    )


def seller_risk(raw: dict[str, DataFrame], min_orders: int = 50, top: int = 20) -> DataFrame:
    """Q12: sellers by low-review rate (item x review grain), sorted on unrounded rates."""
    t = _seller_item_review_totals(raw).where(F.col("delivered_orders") >= min_orders)
    t = t.withColumn("_low", F.col("low_rows") / F.col("rows")).withColumn("_late", F.col("late_rows") / F.col("rows"))
    top_rows = t.orderBy(F.desc("_low"), F.desc("_late"), F.asc("seller_id")).limit(top)
    return top_rows.select(
        "seller_id",
        "delivered_orders",
        round_ratio("score_sum", "rows", 2).alias("avg_review_score"),
        rate_pct("low_rows", "rows").alias("low_review_rate_pct"),
        rate_pct("late_rows", "rows").alias("late_delivery_rate_pct"),
    )


def seller_on_time_risk(
    raw: dict[str, DataFrame], min_orders: int = 50, min_on_time: int = 30, top: int = 20
) -> DataFrame:
    """Q20 (H12): on-time low-review rate per seller, item x review grain."""
    t = _seller_item_review_totals(raw).where(
        (F.col("delivered_orders") >= min_orders) & (F.col("on_time_orders") >= min_on_time)
    )
    t = t.withColumn("_otl", F.col("on_time_low_rows") / F.col("on_time_rows")).withColumn(
        "_late", F.col("late_rows") / F.col("rows")
    )
    top_rows = t.orderBy(F.desc_nulls_last("_otl"), F.desc("_late"), F.asc("seller_id")).limit(top)
    return top_rows.select(
        "seller_id",
        "delivered_orders",
        "on_time_orders",
        round_ratio("score_sum", "rows", 2).alias("avg_review_score"),
        rate_pct("low_rows", "rows").alias("low_review_rate_pct"),
        rate_pct("late_rows", "rows").alias("late_delivery_rate_pct"),
        rate_pct("on_time_low_rows", "on_time_rows").alias("on_time_low_review_rate_pct"),
    )


def seller_order_totals(raw: dict[str, DataFrame]) -> DataFrame:
    """Order-seller grain per seller (pandas form of H12)."""
    so = seller_order_grain(raw).withColumn("is_low", (F.col("mean_score") <= 2).cast("int"))
    on_time = F.col("is_late") == 0
    return so.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("delivered_orders"),
        F.count_if(on_time).alias("on_time_orders"),
        F.sum(F.col("mean_score") * F.lit(2.0)).alias("score_sum_x2"),
        F.sum("is_low").alias("low_orders"),
        F.sum("is_late").alias("late_orders"),
        F.count_if(on_time & (F.col("is_low") == 1)).alias("on_time_low_orders"),
    )


def seller_on_time_risk_order(
    raw: dict[str, DataFrame], min_orders: int = 50, min_on_time: int = 30, top: int = 20
) -> DataFrame:
    """Order-seller grain; sorted on the rounded rates (as the pandas export)."""
    t = seller_order_totals(raw).where(
        (F.col("delivered_orders") >= min_orders) & (F.col("on_time_orders") >= min_on_time)
    )
    out = t.select(
        "seller_id",
        "delivered_orders",
        "on_time_orders",
        round_ratio("score_sum_x2", F.col("delivered_orders") * 2, 2).alias("avg_review_score"),
        rate_pct("low_orders", "delivered_orders").alias("low_review_rate_pct"),
        rate_pct("late_orders", "delivered_orders").alias("late_delivery_rate_pct"),
        rate_pct("on_time_low_orders", "on_time_orders").alias("on_time_low_review_rate_pct"),
    )
    return out.orderBy(
        F.desc("on_time_low_review_rate_pct"), F.desc("late_delivery_rate_pct"), F.asc("seller_id")
    ).limit(top)
