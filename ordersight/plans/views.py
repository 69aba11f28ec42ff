"""Named views over the workspace tables.

``register_views`` exposes the six raw tables and the order fact table under
the names the SQL scripts use, so the same analyses can be written in Spark SQL
(``spark.sql(...)``) against the persisted workspace.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ordersight.plans.context import workspace

# View names of the SQL path.
VIEW_NAMES = {
    "orders": "raw_orders",
    "order_items": "raw_order_items",
    "order_reviews": "raw_order_reviews",
    "customers": "raw_customers",
    "products": "raw_products",
    "category_translation": "raw_category_translation",
}
MART_VIEW = "mart_order_fact"


def register_views(spark: SparkSession, location: str, source: str = "testdata") -> list[str]:
    """Create or replace the temp views; returns the view names."""
    ws = workspace(spark, location, source)
    for table, view in VIEW_NAMES.items():
        ws.raw[table].createOrReplaceTempView(view)
    ws.mart.createOrReplaceTempView(MART_VIEW)
    return [*VIEW_NAMES.values(), MART_VIEW]
