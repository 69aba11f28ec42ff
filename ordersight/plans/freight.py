"""Freight-ratio terciles (Q15, Q16, Q16b; H6/H7).

The ratio is ``freight_revenue / item_revenue`` as a double; ties are broken
by ``order_id`` so every tile assignment is deterministic (D8).  SQL tiles
(NTILE) and pandas tiles (qcut on ranks) differ in size rules and, for the
crosstab, in whether the lateness filter runs before or after tiling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions.columns import (
    FREIGHT_BUCKETS,
    delivery_status,
    rate_pct,
    round_half_up,
    tercile_label,
)
from ordersight.operators.mart import delivered_reviewed
from ordersight.operators.shared import remembered
from ordersight.operators.tiles import tile_cuts, tile_of
from ordersight.plans.descriptive import avg_score_2dp, flag_rate_2dp


def _has_ratio() -> Column:
    return F.col("item_revenue").isNotNull() & (F.col("item_revenue") > 0) & F.col("freight_revenue").isNotNull()


def freight_ratio() -> Column:
    return F.col("freight_revenue").cast("double") / F.col("item_revenue").cast("double")


def freight_base(mart: DataFrame, late_known: bool = False) -> DataFrame:
    base = delivered_reviewed(mart).where(_has_ratio())
    if late_known:
        base = base.where(F.col("is_late_delivery").isNotNull())
    return base.select("order_id", "review_score", "is_low_review", "is_late_delivery", freight_ratio().alias("freight_ratio"))


def _order() -> list[Column]:
    return [F.col("freight_ratio"), F.col("order_id")]


def _cuts(mart: DataFrame, late_known: bool) -> dict:
    base = freight_base(mart, late_known)
    return remembered(mart, f"freight_cuts_{late_known}", lambda: tile_cuts(base, _order()))


def with_freight_tercile(orders: DataFrame, mart: DataFrame, method: str) -> DataFrame:
    """``orders`` of the mart with ``freight_ratio_tercile``, NULL outside the freight population."""
    rated = orders.withColumn("freight_ratio", F.when(_has_ratio(), freight_ratio()))
    tile = tile_of(_order(), _cuts(mart, False), 3, method)
    return rated.withColumn("freight_ratio_tercile", F.when(F.col("freight_ratio").isNotNull(), tile))


def terciles(mart: DataFrame, method: str, late_known: bool = False) -> DataFrame:
    """Freight base with exact terciles; the cuts of both rules are selected once per mart and population."""
    return freight_base(mart, late_known).withColumn(
        "freight_ratio_tercile", tile_of(_order(), _cuts(mart, late_known), 3, method)
    )


def freight_terciles(mart: DataFrame, method: str = "ntile") -> DataFrame:
    """Q15: terciles of the freight ratio - SQL NTILE(3), or ``method="qcut"`` as the pandas export."""
    t = terciles(mart, method)
    out = t.groupBy("freight_ratio_tercile").agg(
        F.count(F.lit(1)).alias("orders"),
        round_half_up(F.avg("freight_ratio"), 3).alias("avg_freight_ratio"),
        avg_score_2dp().alias("avg_review_score"),
        flag_rate_2dp("is_low_review").alias("low_review_rate_pct"),
    )
    return out.select(
        "freight_ratio_tercile",
        tercile_label("freight_ratio_tercile", FREIGHT_BUCKETS).alias("freight_ratio_bucket"),
        "orders",
        "avg_freight_ratio",
        "avg_review_score",
        "low_review_rate_pct",
    ).orderBy("freight_ratio_tercile")


def _crosstab(t: DataFrame) -> DataFrame:
    out = (
        t.withColumn("freight_ratio_bucket", tercile_label("freight_ratio_tercile", FREIGHT_BUCKETS))
        .withColumn("delivery_status", delivery_status("is_late_delivery"))
        .groupBy("freight_ratio_tercile", "freight_ratio_bucket", "delivery_status")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            flag_rate_2dp("is_low_review").alias("low_review_rate_pct"),
        )
    )
    return out.orderBy("freight_ratio_tercile", "delivery_status").drop("freight_ratio_tercile")


def freight_late_crosstab(mart: DataFrame) -> DataFrame:
    """Q16: tercile x lateness, tiles computed after the lateness filter (SQL)."""
    return _crosstab(terciles(mart, "ntile", late_known=True))


def freight_late_crosstab_pretiled(mart: DataFrame) -> DataFrame:
    """Tercile x lateness, qcut tiles computed before the lateness filter (pandas)."""
    t = terciles(mart, "qcut").where(F.col("is_late_delivery").isNotNull())
    return _crosstab(t)


def freight_tercile_counts(mart: DataFrame) -> DataFrame:
    """Per qcut tercile: orders, low-review orders (input of the H6 tests and chart)."""
    t = terciles(mart, "qcut")
    return t.groupBy("freight_ratio_tercile").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("is_low_review") == 1).alias("low_orders"),
    )


def h6_rate_table(mart: DataFrame) -> DataFrame:
    """Q35 (H6 part): qcut tercile -> orders, low orders, rate."""
    c = freight_tercile_counts(mart)
    return c.select(
        F.col("freight_ratio_tercile").alias("tercile"),
        (F.col("orders") - F.col("low_orders")).alias("not_low_orders"),
        "low_orders",
        rate_pct("low_orders", "orders").alias("low_review_rate_pct"),
    ).orderBy("tercile")
