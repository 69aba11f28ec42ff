"""Hot-key paths: results stay exact when one key holds a third of the rows.

The skewed inputs are derived from the given sf0.001 tables by Spark
transformations (test fixtures only; no registered query uses them).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF001
from ordersight.operators.first_orders import first_reviewed_orders
from ordersight.operators.mart import build_mart
from ordersight.operators.tiles import add_tiles
from ordersight.sources.adapter import raw_tables_from_testdata


def _skewed_raw(spark):
    raw = raw_tables_from_testdata(spark, SF001)
    hot = raw["customers"].agg(F.min("customer_id")).first()[0]
    raw["orders"] = raw["orders"].withColumn(
        "customer_id", F.when(F.col("order_id") % 3 == 0, F.lit(hot)).otherwise(F.col("customer_id"))
    )
    return raw


def test_first_orders_with_a_hot_customer(spark):
    mart = build_mart(_skewed_raw(spark))
    got = first_reviewed_orders(mart, "2100-01-01").select(
        "customer_unique_id", "order_id", "next_order_id"
    ).toPandas()
    pdf = mart.where("order_status = 'delivered'").select(
        "customer_unique_id", "order_id", "order_purchase_timestamp", "review_score"
    ).toPandas()
    pdf = pdf.sort_values(["customer_unique_id", "order_purchase_timestamp", "order_id"])
    pdf["n"] = pdf.groupby("customer_unique_id").cumcount()
    pdf["next"] = pdf.groupby("customer_unique_id")["order_id"].shift(-1)
    want = pdf[(pdf["n"] == 0) & pdf["review_score"].notna()]
    assert pdf.groupby("customer_unique_id").size().max() > len(pdf) // 4  # the hot customer exists
    a = sorted(zip(got.customer_unique_id, got.order_id, got.next_order_id.fillna(-1)))
    b = sorted(zip(want.customer_unique_id, want.order_id, want["next"].fillna(-1)))
    assert a == b


def test_tiles_with_a_hot_value(spark):
    base = spark.read.parquet(f"{SF001}/orders.parquet").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("x"),
    )
    pdf = base.toPandas().sort_values(["x", "order_id"]).reset_index(drop=True)
    pdf["rank"] = range(1, len(pdf) + 1)
    q = pd.qcut(pdf["rank"], 3, labels=[1, 2, 3]).astype(int)
    want_q = dict(zip(pdf["order_id"], q))
    got_q = {r.order_id: r.tile for r in add_tiles(base, [F.col("x"), F.col("order_id")], 3, "qcut").collect()}
    assert got_q == want_q
    n = len(pdf)
    sizes = [n // 3 + (1 if i < n % 3 else 0) for i in range(3)]
    bounds = [sum(sizes[: i + 1]) for i in range(3)]
    want_n = {oid: next(i + 1 for i, b in enumerate(bounds) if r <= b) for oid, r in zip(pdf["order_id"], pdf["rank"])}
    got_n = {r.order_id: r.tile for r in add_tiles(base, [F.col("x"), F.col("order_id")], 3, "ntile").collect()}
    assert got_n == want_n
