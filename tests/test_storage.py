"""Rejected rows, versioned rebuilds, bucketed tables, input changes and hot join keys."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from ordersight.operators import categories, skew
from ordersight.operators.grains import order_review_stats
from ordersight.operators.mart import build_mart, order_item_aggregates, order_review_aggregates
from ordersight.plans.context import workspace
from ordersight.schemas import MART_COLUMNS, RAW_SCHEMAS
from ordersight.sources import readers, stored
from ordersight.sources.adapter import raw_tables_from_testdata
from test_plans import plan_text

FILES = {
    "orders": (
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date",
        ["o1,c1,delivered,2018-01-01 10:00:00,,,2018-01-05 10:00:00,2018-01-10 00:00:00", "o2,c1,shipped,2018-01-02 10:00:00,,,,2018-01-12 00:00:00"],
        "o3,c1,delivered,not a time,,,,2018-01-10 00:00:00",
    ),
    "order_items": (
        "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value",
        ["o1,1,p1,s1,2018-01-03 00:00:00,10.00,1.50", "o2,1,p2,s1,,20.00,2.50"],
        "o2,two,p2,s1,,20.00,2.50",
    ),
    "order_reviews": (
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp",
        ['r1,o1,5,"fine, ""really""","two\nlines",2018-01-06 00:00:00,2018-01-07 00:00:00', "r2,o2,1,,,,"],
        "r3,o2,many,,,,",
    ),
    "customers": (
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state",
        ["c1,u1,01000,sao paulo,SP", "c2,u2,02000,rio,RJ"],
        "c3,u3",
    ),
    "products": (
        "product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm",
        ["p1,toys,1,2,3,4,5,6,7", "p2,,1,2,3,4,5,6,7"],
        "p3,toys,1,2,3,heavy,5,6,7",
    ),
    "category_translation": ("product_category_name,product_category_name_english", ["toys,Toys", "livros,books"], "a,b,c,d"),
}


def write_files(folder, with_bad: bool) -> str:
    for table, (header, good, bad) in FILES.items():
        lines = [header, good[0], *([bad] if with_bad else []), *good[1:]]
        (folder / f"{table}.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_malformed_rows_are_set_apart(spark, tmp_path):
    folder = write_files(tmp_path, with_bad=True)
    tables, rejects = readers.read_raw_csv_dir_checked(spark, folder)
    for table in FILES:
        assert tables[table].columns == [f.name for f in RAW_SCHEMAS[table].fields]
        assert tables[table].count() == 2, table
    bad = {r.table_name: r for r in rejects.collect()}
    assert set(bad) == set(FILES)
    assert all(bad[t].record == FILES[t][2] and bad[t].file.endswith(f"/{t}.csv") for t in FILES)
    assert {(r.table_name, r.rejected_rows) for r in readers.reject_counts(rejects).collect()} == {(t, 1) for t in FILES}
    # stored through the source switch; the mart builds from the good rows
    loaded = readers.load_raw_tables(spark, "csv_checked", folder, rejects_path=str(tmp_path / "rejects"))
    assert build_mart(loaded).count() == 2 and spark.read.parquet(str(tmp_path / "rejects")).count() == 6
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        readers.load_raw_tables(spark, "csv", folder)["order_items"].collect()


def test_files_without_bad_rows_load_whole(spark, tmp_path):
    folder = write_files(tmp_path, with_bad=False)
    tables, rejects = readers.read_raw_csv_dir_checked(spark, folder)
    plain = readers.load_raw_tables(spark, "csv", folder)
    assert rejects.count() == 0
    for table in FILES:
        assert sorted(map(str, tables[table].collect())) == sorted(map(str, plain[table].collect()))


def test_a_failing_rebuild_leaves_the_old_table(spark, tmp_path):
    where = str(tmp_path / "mart")
    with pytest.raises(FileNotFoundError):
        stored.read_current(spark, where)
    assert stored.rebuild(spark.range(3), where, view="numbers").count() == 3
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        stored.rebuild(broken, where, view="numbers")
    assert stored.read_current(spark, where).count() == 3 and spark.table("numbers").count() == 3
    # the folder of the failed version is not taken again
    assert stored.rebuild(spark.range(5), where, view="numbers").count() == 5
    assert spark.table("numbers").columns == ["id"] and spark.table("numbers").count() == 5
    stored.rebuild(spark.range(6), where)
    assert len(stored.versions(spark, where)) == 2 and stored.read_current(spark, where).count() == 6


def test_load_mart_from_versions_and_parquet(spark, tmp_path):
    mart = build_mart(raw_tables_from_testdata(spark, SF001))
    stored.rebuild(mart, str(tmp_path / "m"))
    assert readers.load_mart(spark, "versions", str(tmp_path / "m")).columns == list(MART_COLUMNS)
    latest = stored.versions(spark, str(tmp_path / "m"))[-1]
    again = readers.load_mart(spark, "parquet", str(tmp_path / "m" / f"v={latest}"))
    assert again.exceptAll(mart).count() == 0 and again.count() == mart.count()


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    raw = raw_tables_from_testdata(spark, SF001)
    stored.write_bucketed(raw, "bk_", 4, str(tmp_path))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        t = readers.load_raw_tables(spark, "tables", "bk_")
        joined = (
            t["orders"]
            .join(order_item_aggregates(t["order_items"].drop("seller_id").withColumn("seller_id", F.lit(1))), "order_id", "left")
            .join(order_review_aggregates(t["order_reviews"]), "order_id", "left")
        )
        physical = plan_text(joined).split("\n\n")[0]
        assert "Exchange" not in physical and physical.count("SortMergeJoin") == 2
        physical = plan_text(t["order_items"].join(order_review_stats(t["order_reviews"]), "order_id")).split("\n\n")[0]
        assert "Exchange" not in physical
        stored_mart, plain = build_mart(t), build_mart(raw)
        assert stored_mart.exceptAll(plain).count() == 0 and stored_mart.count() == plain.count()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        for table in RAW_SCHEMAS:
            spark.sql(f"DROP TABLE IF EXISTS bk_{table}")


def test_changed_files_give_new_results(spark, tmp_path):
    folder = write_files(tmp_path, with_bad=False)
    first = workspace(spark, folder, "csv")
    assert first.mart.count() == 2 and workspace(spark, folder, "csv") is first
    with open(f"{folder}/orders.csv", "a") as f:
        f.write("o9,c2,delivered,2018-01-03 10:00:00,,,2018-01-05 10:00:00,2018-01-10 00:00:00\n")
    second = workspace(spark, folder, "csv")
    assert second is not first and second.mart.count() == 3
    second.release()


def test_hot_products_and_customers_are_dealt_over_tasks(spark):
    raw = raw_tables_from_testdata(spark, SF001)
    hot_product = raw["products"].agg(F.min("product_id")).first()[0]
    hot_customer = raw["customers"].agg(F.min("customer_id")).first()[0]
    raw["order_items"] = raw["order_items"].withColumn(
        "product_id", F.when(F.col("order_id") % 3 == 0, F.lit(hot_product)).otherwise(F.col("product_id"))
    )
    raw["orders"] = raw["orders"].withColumn(
        "customer_id", F.when(F.col("order_id") % 3 == 0, F.lit(hot_customer)).otherwise(F.col("customer_id"))
    )
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert [r.heavy_key for r in skew.heavy_keys(raw["order_items"], "product_id").collect()] == [hot_product]
        cats = categories.product_categories(raw["products"], raw["category_translation"])
        items = raw["order_items"].select("order_id", "product_id")
        sizes = {}
        for name, joined in (
            ("plain", items.join(cats, "product_id", "left")),
            ("salted", skew.salted_join(items, cats, "product_id", "order_id")),
        ):
            sizes[name] = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes["plain"]) == sum(sizes["salted"])
        assert max(sizes["salted"]) <= 2 * statistics.median(sizes["salted"]) < max(sizes["plain"])
        plain, isolated = build_mart(raw), build_mart(raw, isolate_hot=True)
        assert plain.count() == isolated.count() and plain.exceptAll(isolated).count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
