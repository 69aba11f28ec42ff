"""Product categories of order items — one item-level lookup shared by all users.

The item -> product join is the most expensive join (item-scale data on both
sides).  It is done once, straight into the grain ``(order_id, category,
orphan) -> n_items``, which is all that any analysis needs from it:

- the mart's sorted distinct category list per order,
- the item x review grain per category (SQL form: unknown products count as
  'unknown'),
- the item grain per category (pandas form: items of unknown products are
  dropped, i.e. ``orphan = false``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.operators.shared import shared
from ordersight.operators.skew import salted_join

UNKNOWN = "unknown"


def product_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """product_id -> english name, else native name (NULL when neither exists)."""
    # A size-checked broadcast hint on ``translation`` (see plans.context) is kept;
    # without one, AQE broadcasts the side at runtime when its shuffle output is small.
    tr = translation.select("product_category_name", "product_category_name_english")
    p = products.select("product_id", "product_category_name")
    return p.join(tr, "product_category_name", "left").select(
        "product_id",
        F.coalesce("product_category_name_english", "product_category_name").alias("product_category"),
        F.lit(True).alias("_matched"),
    )


def category_item_counts(items: DataFrame, products: DataFrame, translation: DataFrame, isolate_hot: bool = False) -> DataFrame:
    """``(order_id, category, orphan, n_items)``; category is english, native or 'unknown'.

    With ``isolate_hot`` the items of heavy products are dealt over several tasks of the lookup
    (``operators.skew``), which costs one more pass over the product key.
    """
    cats = product_categories(products, translation)
    it = items.select("order_id", "product_id")
    it = salted_join(it, cats, "product_id", "order_id") if isolate_hot else it.join(cats, "product_id", "left")
    return it.groupBy(
        "order_id",
        F.coalesce(F.col("product_category"), F.lit(UNKNOWN)).alias("category"),
        F.col("_matched").isNull().alias("orphan"),
    ).agg(F.count(F.lit(1)).alias("n_items"))


def category_counts(raw: dict[str, DataFrame], isolate_hot: bool = False) -> DataFrame:
    """The shared grain, built once per workspace."""
    return shared(
        raw,
        "category_counts",
        lambda: category_item_counts(raw["order_items"], raw["products"], raw["category_translation"], isolate_hot),
    )
