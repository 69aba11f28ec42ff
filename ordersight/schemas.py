"""Fixed schemas of the six raw tables and of the order mart.

Ids are strings in the CSV form of the data; the test-data adapter produces
``bigint`` ids.  Nothing downstream depends on the id type.
"""

from pyspark.sql.types import (
    DecimalType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(12, 2)

RAW_ORDERS = StructType(
    [
        StructField("order_id", StringType(), False),
        StructField("customer_id", StringType(), True),
        StructField("order_status", StringType(), True),
        StructField("order_purchase_timestamp", TimestampNTZType(), True),
        StructField("order_delivered_customer_date", TimestampNTZType(), True),
        StructField("order_estimated_delivery_date", TimestampNTZType(), True),
    ]
)

RAW_ORDER_ITEMS = StructType(
    [
        StructField("order_id", StringType(), False),
        StructField("order_item_id", IntegerType(), False),
        StructField("product_id", StringType(), True),
        StructField("seller_id", StringType(), True),
        StructField("shipping_limit_date", TimestampNTZType(), True),
        StructField("price", MONEY, True),
        StructField("freight_value", MONEY, True),
    ]
)

RAW_ORDER_REVIEWS = StructType(
    [
        StructField("review_id", StringType(), True),
        StructField("order_id", StringType(), True),
        StructField("review_score", IntegerType(), True),
        StructField("review_creation_date", TimestampNTZType(), True),
        StructField("review_answer_timestamp", TimestampNTZType(), True),
    ]
)

RAW_CUSTOMERS = StructType(
    [
        StructField("customer_id", StringType(), False),
        StructField("customer_unique_id", StringType(), True),
        StructField("customer_zip_code_prefix", StringType(), True),
        StructField("customer_city", StringType(), True),
        StructField("customer_state", StringType(), True),
    ]
)

RAW_PRODUCTS = StructType(
    [
        StructField("product_id", StringType(), False),
        StructField("product_category_name", StringType(), True),
        StructField("product_name_lenght", IntegerType(), True),
        StructField("product_description_lenght", IntegerType(), True),
        StructField("product_photos_qty", IntegerType(), True),
        StructField("product_weight_g", IntegerType(), True),
        StructField("product_length_cm", IntegerType(), True),
        StructField("product_height_cm", IntegerType(), True),
        StructField("product_width_cm", IntegerType(), True),
    ]
)

RAW_CATEGORY_TRANSLATION = StructType(
    [
        StructField("product_category_name", StringType(), False),
        StructField("product_category_name_english", StringType(), True),
    ]
)

RAW_SCHEMAS = {
    "orders": RAW_ORDERS,
    "order_items": RAW_ORDER_ITEMS,
    "order_reviews": RAW_ORDER_REVIEWS,
    "customers": RAW_CUSTOMERS,
    "products": RAW_PRODUCTS,
    "category_translation": RAW_CATEGORY_TRANSLATION,
}

# Columns of the order-level fact table, in output order.
MART_COLUMNS = [
    "order_id",
    "customer_unique_id",
    "customer_state",
    "order_status",
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    "item_count",
    "seller_count",
    "item_revenue",
    "freight_revenue",
    "order_gmv",
    "categories",
    "review_score",
    "delivery_days",
    "delivery_delay_days",
    "is_late_delivery",
    "is_low_review",
]
