"""Test-data adapter: driver tables (TPC-H-like star schema) -> six raw tables.

The reference ships no raw data, so the analyses run on a deterministic mapping
of the generated tables.  The mapping uses integer arithmetic only, so that an
independent SQL engine can rebuild exactly the same rows.

Fixed values of the mapping (the test-data contract):
    customer_id                    = o_custkey * 20 + o_orderkey % 20
    order_status                   = 'shipped' if o_orderstatus = 'P' and o_orderkey is even,
                                     else 'delivered'
    order_purchase_timestamp       = o_orderdate + (o_orderkey % 24) hours
    gap                            = pmod(datediff(min(l_shipdate), o_orderdate), 36)
    order_delivered_customer_date  = NULL if o_orderkey % 97 = 0 or the order has no items,
                                     else o_orderdate + gap days + (o_orderkey * 7 % 24) hours + 30 min
    order_estimated_delivery_date  = o_orderdate + 24 days
    product_id                     = -1 if l_partkey % 211 = 0 (orphan), else l_partkey
    price                          = l_extendedprice as decimal(12,2)
    freight_value                  = int(l_quantity) * 0.5 as decimal(12,2)
    reviews                        = none if order_id % 101 = 0; first score
                                     greatest(1, 1 + (priority digit * 3 + order_id) % 5 - 2 * late);
                                     a second review (score + 1, at most 5) if order_id % 50 = 0
    customers                      = each c_custkey expands to ids c_custkey * 20 + k, k in 0..19;
                                     customer_unique_id = id div 2; customer_state = nation name
    product_category_name          = '' if p_partkey % 61 = 0, else lower(p_brand) with
                                     'brand#' replaced by 'cat_'
    category translation           = every cat_N except cat_13 -> 'category_N'
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.sources.readers import normalize_empty_strings

DRIVER_TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
]


def _null(type_name: str):
    return F.lit(None).cast(type_name)


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _late(delivered, estimated):
    return F.when(delivered.isNotNull() & (delivered > estimated), F.lit(2)).otherwise(F.lit(0))


def adapt_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    first_ship = lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("_ms"))
    o = orders.join(first_ship, orders.o_orderkey == first_ship.l_orderkey, "left")
    gap = F.pmod(F.datediff(F.col("_ms"), F.col("o_orderdate")), F.lit(36))
    key = F.col("o_orderkey")
    delivered = F.when((key % 97 == 0) | gap.isNull(), _null("timestamp_ntz")).otherwise(
        F.col("o_orderdate")
        + F.make_dt_interval(gap.cast("int"), ((key * 7) % 24).cast("int"), F.lit(30), F.lit(0))
    )
    return o.select(
        key.alias("order_id"),
        (F.col("o_custkey") * 20 + key % 20).alias("customer_id"),
        F.when((F.col("o_orderstatus") == "P") & (key % 2 == 0), F.lit("shipped"))
        .otherwise(F.lit("delivered"))
        .alias("order_status"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (key % 24).cast("int"))).alias(
            "order_purchase_timestamp"
        ),
        delivered.alias("order_delivered_customer_date"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(24))).alias("order_estimated_delivery_date"),
        F.col("o_orderpriority").alias("_priority"),
    )


def adapt_reviews(orders_with_priority: DataFrame) -> DataFrame:
    o = orders_with_priority.where(F.col("order_id") % 101 != 0)
    digit = F.substring("_priority", 1, 1).cast("int")
    first_score = F.greatest(
        F.lit(1),
        F.lit(1)
        + (digit * 3 + F.col("order_id")) % 5
        - _late(F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")),
    )
    o = o.select("order_id", first_score.cast("int").alias("_s1"))
    # One or two reviews per order, produced by exploding a tiny per-row array.
    o = o.withColumn(
        "_k",
        F.explode(F.when(F.col("order_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    )
    return o.select(
        (F.col("order_id") * 2 + F.col("_k")).alias("review_id"),
        F.col("order_id"),
        F.when(F.col("_k") == 0, F.col("_s1"))
        .otherwise(F.least(F.lit(5), F.col("_s1") + 1))
        .cast("int")
        .alias("review_score"),
        _null("timestamp_ntz").alias("review_creation_date"),
        _null("timestamp_ntz").alias("review_answer_timestamp"),
    )


def adapt_items(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.when(F.col("l_partkey") % 211 == 0, F.lit(-1).cast("bigint"))
        .otherwise(F.col("l_partkey"))
        .alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        (F.col("l_quantity").cast("int") * F.lit(0.5)).cast("decimal(12,2)").alias("freight_value"),
    )


def adapt_customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    nations = nation.select(F.col("n_nationkey"), F.col("n_name").alias("customer_state"))
    c = customer.select("c_custkey", "c_nationkey").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(19))))
    c = c.join(nations, c.c_nationkey == nations.n_nationkey, "inner")
    cid = F.col("c_custkey") * 20 + F.col("_k")
    return c.select(
        cid.alias("customer_id"),
        F.expr("(c_custkey * 20 + _k) div 2").alias("customer_unique_id"),
        _null("string").alias("customer_zip_code_prefix"),
        _null("string").alias("customer_city"),
        F.col("customer_state"),
    )


def _brand_category(brand):
    return F.regexp_replace(F.lower(brand), "brand#", "cat_")


def adapt_products(part: DataFrame) -> DataFrame:
    cat = F.when(F.col("p_partkey") % 61 == 0, F.lit("")).otherwise(_brand_category(F.col("p_brand")))
    return part.select(
        F.col("p_partkey").alias("product_id"),
        cat.alias("product_category_name"),
        *[
            _null("int").alias(c)
            for c in [
                "product_name_lenght",
                "product_description_lenght",
                "product_photos_qty",
                "product_weight_g",
                "product_length_cm",
                "product_height_cm",
                "product_width_cm",
            ]
        ],
    )


def adapt_category_translation(part: DataFrame) -> DataFrame:
    names = (
        part.where(F.col("p_brand") != "Brand#13")
        .select(_brand_category(F.col("p_brand")).alias("product_category_name"))
        .distinct()
    )
    return names.select(
        "product_category_name",
        F.regexp_replace("product_category_name", "^cat_", "category_").alias("product_category_name_english"),
    )


def raw_tables_from_testdata(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six raw tables, built lazily from the driver's Parquet files.

    Empty strings are normalised to NULL exactly as the CSV loader does (S8),
    so the '' category of the products table becomes 'unknown' downstream.
    """
    t = {name: read_driver_table(spark, sf_dir, name) for name in DRIVER_TABLES}
    orders_p = adapt_orders(t["orders"], t["lineitem"])
    raw = {
        "orders": orders_p.drop("_priority"),
        "order_items": adapt_items(t["lineitem"]),
        "order_reviews": adapt_reviews(orders_p),
        "customers": adapt_customers(t["customer"], t["nation"]),
        "products": adapt_products(t["part"]),
        "category_translation": adapt_category_translation(t["part"]),
    }
    return {name: normalize_empty_strings(df) for name, df in raw.items()}
