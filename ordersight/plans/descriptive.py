"""Descriptive analyses at the order grain (Q08, Q09, Q13 - Q18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions.columns import (
    DELAY_BUCKETS,
    delay_bucket,
    delivery_status,
    elapsed_days,
    item_complexity,
    label_ordinal,
    rate_pct,
    round_ratio,
    seller_complexity,
)
from ordersight.operators.mart import delivered_reviewed


def _score_sum_x2(score: str = "review_score"):
    """Twice the score sum: exact for integer and half-integer order scores."""
    return F.sum(F.col(score) * F.lit(2.0))


def avg_score_2dp(score: str = "review_score"):
    """Rounded mean of a (half-)integer score column, rounded from its exact value."""
    return round_ratio(_score_sum_x2(score), F.count(score) * F.lit(2), 2)


def flag_rate_2dp(flag: str):
    """``ROUND(100 * AVG(flag), 2)`` for a 0/1/NULL flag (NULLs ignored)."""
    return rate_pct(F.count_if(F.col(flag) == 1), F.count(flag), 2)


def overall_satisfaction(mart: DataFrame) -> DataFrame:
    """Q08: size, mean score and low-review rate of the delivered+reviewed population."""
    return delivered_reviewed(mart).agg(
        F.count(F.lit(1)).alias("reviewed_delivered_orders"),
        avg_score_2dp().alias("avg_review_score"),
        flag_rate_2dp("is_low_review").alias("low_review_rate_pct"),
    )


def delay_bucket_reviews(mart: DataFrame) -> DataFrame:
    """Q09 (H1): orders, mean score and low-review rate per delivery-delay bucket."""
    base = delivered_reviewed(mart).where(F.col("delivery_delay_days").isNotNull())
    out = (
        base.withColumn("delivery_bucket", delay_bucket("delivery_delay_days"))
        .groupBy("delivery_bucket")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            avg_score_2dp().alias("avg_review_score"),
            flag_rate_2dp("is_low_review").alias("low_review_rate_pct"),
        )
    )
    return out.orderBy(label_ordinal("delivery_bucket", DELAY_BUCKETS))


def _late_known(mart: DataFrame) -> DataFrame:
    return delivered_reviewed(mart).where(F.col("is_late_delivery").isNotNull())


def region_reviews(mart: DataFrame, min_orders: int = 200) -> DataFrame:
    """Q13 (H5): per customer state with at least ``min_orders`` orders."""
    agg = (
        _late_known(mart)
        .groupBy("customer_state")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            flag_rate_2dp("is_late_delivery").alias("late_delivery_rate_pct"),
            avg_score_2dp().alias("avg_review_score"),
            flag_rate_2dp("is_low_review").alias("low_review_rate_pct"),
        )
        .where(F.col("orders") >= min_orders)
    )
    return agg.orderBy(F.desc("low_review_rate_pct"), F.desc("orders"), F.asc("customer_state"))


def region_late_stratified(mart: DataFrame, min_orders: int = 200) -> DataFrame:
    """Q14: state x lateness for the large states, filtered on the aggregated totals."""
    out = (
        _late_known(mart)
        .withColumn("delivery_status", delivery_status("is_late_delivery"))
        .groupBy("customer_state", "delivery_status")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            avg_score_2dp().alias("avg_review_score"),
            flag_rate_2dp("is_low_review").alias("low_review_rate_pct"),
        )
        # at most two rows per state are left here
        .withColumn("in_state", F.sum("orders").over(Window.partitionBy("customer_state")))
        .where((F.col("in_state") >= min_orders) & F.col("customer_state").isNotNull())
        .drop("in_state")
    )
    return out.orderBy("customer_state", "delivery_status")


def _complexity_base(mart: DataFrame) -> DataFrame:
    return delivered_reviewed(mart).where(F.col("item_count").isNotNull() & F.col("seller_count").isNotNull())


def order_complexity(mart: DataFrame) -> DataFrame:
    """Q17 (H8): item x seller complexity."""
    out = (
        _complexity_base(mart)
        .withColumn("item_complexity", item_complexity("item_count"))
        .withColumn("seller_complexity", seller_complexity("seller_count"))
        .groupBy("item_complexity", "seller_complexity")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            avg_score_2dp().alias("avg_review_score"),
            flag_rate_2dp("is_low_review").alias("low_review_rate_pct"),
            flag_rate_2dp("is_late_delivery").alias("late_delivery_rate_pct"),
        )
    )
    return out.orderBy(F.desc("low_review_rate_pct"), "item_complexity", "seller_complexity")


def order_complexity_late(mart: DataFrame) -> DataFrame:
    """Q18: item complexity x lateness."""
    base = delivered_reviewed(mart).where(
        F.col("item_count").isNotNull() & F.col("is_late_delivery").isNotNull()
    )
    out = (
        base.withColumn("item_complexity", item_complexity("item_count"))
        .withColumn("delivery_status", delivery_status("is_late_delivery"))
        .groupBy("item_complexity", "delivery_status")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            flag_rate_2dp("is_low_review").alias("low_review_rate_pct"),
        )
    )
    return out.orderBy("item_complexity", "delivery_status")


def delay_population(mart: DataFrame) -> DataFrame:
    """H1 test population: delivered, reviewed, with delay days and a lateness flag."""
    return delivered_reviewed(mart).where(
        F.col("delivery_delay_days").isNotNull() & F.col("is_late_delivery").isNotNull()
    )


def elapsed_delay_days() -> Column:
    """Whole elapsed days from the estimate to the delivery, floored: the tests' day count."""
    return elapsed_days("order_delivered_customer_date", "order_estimated_delivery_date")


def h1_rate_table(mart: DataFrame) -> DataFrame:
    """Q35 (H1 part): delay bucket (elapsed days) x low review counts with the low-review rate."""
    t = (
        delay_population(mart)
        .withColumn("delay_bucket", delay_bucket(elapsed_delay_days()))
        .groupBy("delay_bucket")
        .agg(
            F.count_if(F.col("is_low_review") == 0).alias("not_low_orders"),
            F.count_if(F.col("is_low_review") == 1).alias("low_orders"),
        )
    )
    return t.withColumn(
        "low_review_rate_pct", rate_pct("low_orders", F.col("low_orders") + F.col("not_low_orders"))
    ).orderBy(label_ordinal("delay_bucket", DELAY_BUCKETS))
