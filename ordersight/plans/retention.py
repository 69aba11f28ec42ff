"""Repeat purchase after the first customer experience.

Two groupings of the first-order score exist (D2):
- SQL: <=2 / =3 / >=4, so mean scores 2.5 and 3.5 form a NULL group;
- interval cut (-inf,2] / (2,3] / (3,inf), with every group reported even when empty.
Two day counts exist (D7): calendar days (SQL) and floored elapsed days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions.columns import (
    DELIVERY_STATUSES,
    REVIEW_GROUPS,
    SHORT_REVIEW_GROUPS,
    delivery_status,
    label_ordinal,
    rate_pct,
    review_group_cut,
    review_group_sql,
    round_ratio,
)
from ordersight.operators.first_orders import first_reviewed_orders
from ordersight.operators.ranks import group_medians

GROUP = "first_order_review_group"
STATUS = "first_order_delivery_status"


def _sql_groups(mart: DataFrame, cutoff: str) -> DataFrame:
    return first_reviewed_orders(mart, cutoff).withColumn(GROUP, review_group_sql("review_score"))


def repeat_purchase(mart: DataFrame, cutoff: str) -> DataFrame:
    """Q11: repeat rate by first-order review group (SQL grouping)."""
    out = (
        _sql_groups(mart, cutoff)
        .groupBy(GROUP)
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.count_if(F.col("has_repeat") == 1).alias("customers_with_next_order"),
        )
        .withColumn("repeat_purchase_rate_pct", rate_pct("customers_with_next_order", "customers"))
    )
    return out.orderBy(label_ordinal(GROUP, REVIEW_GROUPS).asc_nulls_first())


def retention_timing(mart: DataFrame, cutoff: str) -> DataFrame:
    """Q21 (H10/H11): repeat rate and mean calendar days to the next order."""
    days = F.col("days_to_next_order")
    out = (
        _sql_groups(mart, cutoff)
        .groupBy(GROUP)
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.count_if(F.col("has_repeat") == 1).alias("customers_with_next_order"),
            F.sum(days).alias("_days"),
            F.count(days).alias("_n_days"),
        )
        .select(
            GROUP,
            "customers",
            "customers_with_next_order",
            rate_pct("customers_with_next_order", "customers").alias("repeat_purchase_rate_pct"),
            round_ratio("_days", "_n_days", 1).alias("avg_days_to_next_order"),
            round_ratio("_days", "_n_days", 1).alias("avg_days_to_next_order_among_repeaters"),
        )
    )
    return out.orderBy(label_ordinal(GROUP, REVIEW_GROUPS).asc_nulls_first())


def _stack(labels: list[str], label_col: str, cols_per_label: list[list[Column]], names: list[str]) -> Column:
    """Generator turning one wide row into one row per label (a dense group list)."""
    return F.inline(
        F.array(
            *[
                F.struct(F.lit(label).alias(label_col), *[c.alias(n) for c, n in zip(cols, names)])
                for label, cols in zip(labels, cols_per_label)
            ]
        )
    )


def retention_timing_elapsed(mart: DataFrame, cutoff: str) -> DataFrame:
    """Interval-cut groups, floored elapsed days, every group reported (dense)."""
    f = first_reviewed_orders(mart, cutoff).withColumn(GROUP, review_group_cut("review_score"))
    aggs = []
    for i, label in enumerate(REVIEW_GROUPS):
        in_g = F.col(GROUP) == label
        aggs += [
            F.count_if(in_g).alias(f"c{i}"),
            F.count_if(in_g & (F.col("has_repeat") == 1)).alias(f"r{i}"),
            F.sum(F.when(in_g, F.col("elapsed_days_to_next_order"))).alias(f"s{i}"),
            F.count(F.when(in_g, F.col("elapsed_days_to_next_order"))).alias(f"n{i}"),
        ]
    wide = f.agg(*aggs)
    long = wide.select(
        _stack(
            REVIEW_GROUPS,
            GROUP,
            [[F.col(f"c{i}"), F.col(f"r{i}"), F.col(f"s{i}"), F.col(f"n{i}")] for i in range(3)],
            ["customers", "customers_with_next_order", "_s", "_n"],
        )
    )
    return long.select(
        GROUP,
        "customers",
        "customers_with_next_order",
        round_ratio("_s", "_n", 1).alias("avg_days_to_next_order_among_repeaters"),
        rate_pct("customers_with_next_order", "customers").alias("repeat_purchase_rate_pct"),
    ).orderBy(label_ordinal(GROUP, REVIEW_GROUPS))


def retention_late_context(mart: DataFrame, cutoff: str) -> DataFrame:
    """Q22: SQL groups x first-order lateness (the NULL group is kept)."""
    base = _sql_groups(mart, cutoff).where(F.col("is_late_delivery").isNotNull())
    out = (
        base.withColumn(STATUS, delivery_status("is_late_delivery"))
        .groupBy(GROUP, STATUS)
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.count_if(F.col("has_repeat") == 1).alias("_r"),
        )
        .select(GROUP, STATUS, "customers", rate_pct("_r", "customers").alias("repeat_purchase_rate_pct"))
    )
    return out.orderBy(F.col(GROUP).asc_nulls_first(), STATUS)


def retention_late_context_cut(mart: DataFrame, cutoff: str) -> DataFrame:
    """Cut groups x observed lateness values, dense over the groups."""
    f = first_reviewed_orders(mart, cutoff).where(F.col("is_late_delivery").isNotNull())
    f = f.withColumn(GROUP, review_group_cut("review_score")).withColumn(STATUS, delivery_status("is_late_delivery"))
    aggs = []
    for i, label in enumerate(REVIEW_GROUPS):
        in_g = F.col(GROUP) == label
        aggs += [
            F.count_if(in_g).alias(f"c{i}"),
            F.count_if(in_g & (F.col("has_repeat") == 1)).alias(f"r{i}"),
        ]
    per_status = f.groupBy(STATUS).agg(*aggs)
    long = per_status.select(
        STATUS,
        _stack(
            REVIEW_GROUPS,
            GROUP,
            [[F.col(f"c{i}"), F.col(f"r{i}")] for i in range(3)],
            ["customers", "customers_with_next_order"],
        ),
    )
    return long.select(
        GROUP,
        STATUS,
        "customers",
        "customers_with_next_order",
        rate_pct("customers_with_next_order", "customers").alias("repeat_purchase_rate_pct"),
    ).orderBy(label_ordinal(GROUP, REVIEW_GROUPS), label_ordinal(STATUS, DELIVERY_STATUSES))


def repeaters_elapsed(mart: DataFrame, cutoff: str) -> DataFrame:
    """Repeaters with short cut labels and elapsed days (input of H11 and Q34)."""
    return (
        first_reviewed_orders(mart, cutoff)
        .where(F.col("has_repeat") == 1)
        .select(
            review_group_cut("review_score", SHORT_REVIEW_GROUPS).alias("review_group"),
            F.col("elapsed_days_to_next_order").alias("days_to_next"),
        )
        .where(F.col("days_to_next").isNotNull())
    )


def h11_group_medians(mart: DataFrame, cutoff: str) -> DataFrame:
    """Q34: exact median of elapsed days to the next order per observed group, by rank selection."""
    medians = group_medians(repeaters_elapsed(mart, cutoff), "days_to_next", "review_group")
    return medians.select(
        "review_group", F.col("median").alias("median_days_to_next_order"), F.col("n").alias("repeaters")
    ).orderBy(label_ordinal("review_group", SHORT_REVIEW_GROUPS))
