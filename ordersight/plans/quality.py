"""Load audit and data-quality checks (Q02 - Q07)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The labels of the load audit, in the reference's order.
ROW_COUNT_LABELS = [
    ("orders", "orders"),
    ("order_items", "order_items"),
    ("reviews", "order_reviews"),
    ("customers", "customers"),
    ("products", "products"),
    ("category_translation", "category_translation"),
]

# Declared keys of every table (the primary keys of the stored tables + the mart grain).
TABLE_KEYS = [
    ("mart_order_fact", ["order_id"]),
    ("raw_orders", ["order_id"]),
    ("raw_order_items", ["order_id", "order_item_id"]),
    ("raw_customers", ["customer_id"]),
    ("raw_products", ["product_id"]),
    ("raw_category_translation", ["product_category_name"]),
]


def table_row_counts(raw: dict[str, DataFrame]) -> DataFrame:
    """Q02: UNION ALL of six labelled row counts."""
    parts = [
        raw[table].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(label).alias("table_name"), "row_count")
        for label, table in ROW_COUNT_LABELS
    ]
    return reduce(DataFrame.unionByName, parts)


def dq_granularity(mart: DataFrame) -> DataFrame:
    """Q03: one row per order?  rows, unique orders, duplicates."""
    return mart.agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_distinct("order_id").alias("unique_orders"),
    ).withColumn("duplicate_rows", F.col("all_rows") - F.col("unique_orders"))


#: Rows whose keys one task tells apart.
KEYS_A_TASK = 500_000


def _key_counts(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """One row: all_rows, null_keys, unique_keys of ``df``, which has about ``rows`` rows.

    Keys are nearly unique, so collecting them per input split would keep whole splits in memory
    and shrink nothing: they are dealt to tasks first, as many as the rows ask for.  Rows
    without a key are dealt too, so they never come together.
    """
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    parts = max(2, -(-rows // KEYS_A_TASK))
    d = df.select(*keys, known.alias("_known"))
    d = d.withColumn("_spread", F.when(~F.col("_known"), F.pmod(F.monotonically_increasing_id(), F.lit(parts))))
    by = [*keys, "_known", "_spread"]
    counts = d.repartition(parts, *by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all_rows"),
        F.coalesce(F.sum(F.when(~F.col("_known"), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if("_known").alias("unique_keys"),
    )


def dq_key_uniqueness(raw: dict[str, DataFrame], mart: DataFrame) -> DataFrame:
    """Q03 extended to every declared key: the uniqueness that the store would enforce.

    One rule for single and composite keys: a key with a NULL part is no key; such rows are
    counted in ``null_keys`` and are neither unique nor duplicates.
    """
    tables = {
        "mart_order_fact": mart,
        "raw_orders": raw["orders"],
        "raw_order_items": raw["order_items"],
        "raw_customers": raw["customers"],
        "raw_products": raw["products"],
        "raw_category_translation": raw["category_translation"],
    }
    sizes = {name: df.count() for name, df in tables.items() if name != "mart_order_fact"}
    sizes["mart_order_fact"] = sizes["raw_orders"]  # one row per order
    parts = []
    for name, keys in TABLE_KEYS:
        parts.append(
            _key_counts(tables[name], keys, sizes[name]).select(
                F.lit(name).alias("table_name"),
                F.lit(", ".join(keys)).alias("key_columns"),
                "all_rows",
                "null_keys",
                "unique_keys",
                (F.col("all_rows") - F.col("null_keys") - F.col("unique_keys")).alias("duplicate_rows"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def dq_status_mix(mart: DataFrame) -> DataFrame:
    """Q04: orders per status."""
    return (
        mart.groupBy("order_status")
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc("orders"), "order_status")
    )


def dq_missing(mart: DataFrame) -> DataFrame:
    """Q05: orders without review / delivery date / items."""
    return mart.agg(
        F.count(F.lit(1)).alias("all_orders"),
        F.count_if(F.col("review_score").isNull()).alias("orders_without_review"),
        F.count_if(F.col("order_delivered_customer_date").isNull()).alias("orders_without_delivery_date"),
        F.count_if(F.col("order_gmv").isNull()).alias("orders_without_items"),
    )


def dq_delivery_ranges(mart: DataFrame) -> DataFrame:
    """Q06: delivery-time extremes of delivered orders."""
    return mart.where(F.col("order_status") == "delivered").agg(
        F.min("delivery_days").alias("min_delivery_days"),
        F.max("delivery_days").alias("max_delivery_days"),
        F.min("delivery_delay_days").alias("min_delivery_delay_days"),
        F.max("delivery_delay_days").alias("max_delivery_delay_days"),
    )


def dq_score_distribution(mart: DataFrame) -> DataFrame:
    """Q07: orders per (possibly fractional) mean review score."""
    return (
        mart.where(F.col("review_score").isNotNull())
        .groupBy("review_score")
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy("review_score")
    )
