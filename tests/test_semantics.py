"""Unit fixtures for the semantic decisions D1 - D14 (tiny literal tables)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fixtures import customer, item, order, product, review, tables
from ordersight.functions.columns import review_group_cut, review_group_sql
from ordersight.operators.first_orders import first_reviewed_orders
from ordersight.operators.mart import build_mart
from ordersight.operators.tiles import add_tiles
from ordersight.plans import descriptive, retention, risk
from ordersight.sources.readers import normalize_empty_strings


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_late_on_estimate_day_is_late_but_on_time_bucket(spark):
    t = tables(
        spark,
        [order("o1", "c1", delivered="2018-01-10 10:00:00", estimated="2018-01-10 00:00:00")],
        [item("o1", 1)],
        [review("r1", "o1", 5)],
        [customer("c1", "u1")],
        [product("p1", "cat")],
    )
    m = build_mart(t).collect()[0]
    assert m.is_late_delivery == 1 and m.delivery_delay_days == 0
    b = descriptive.delay_bucket_reviews(build_mart(t)).collect()
    assert [r.delivery_bucket for r in b] == ["On time or early"]


def test_undelivered_unreviewed_itemless_orders_are_kept(spark):
    t = tables(
        spark,
        [order("o1", "c1", delivered=None), order("o2", "c1"), order("o3", "c1")],
        [item("o1", 1), item("o2", 1)],
        [review("r1", "o1", 4), review("r3", "o3", 4)],
        [customer("c1", "u1")],
        [product("p1", "cat")],
    )
    m = {r.order_id: r for r in build_mart(t).collect()}
    assert len(m) == 3
    assert m["o1"].is_late_delivery is None and m["o1"].delivery_days is None
    assert m["o2"].review_score is None and m["o2"].is_low_review is None
    assert m["o3"].item_count is None and m["o3"].order_gmv is None and m["o3"].categories is None


def test_fractional_mean_score_groups(spark):
    t = tables(
        spark,
        [order("o1", "c1")],
        [item("o1", 1)],
        [review("r1", "o1", 2), review("r2", "o1", 3)],
        [customer("c1", "u1")],
        [product("p1", "cat")],
    )
    m = build_mart(t)
    r = m.select(
        "review_score", "is_low_review", review_group_sql("review_score").alias("g_sql"),
        review_group_cut("review_score").alias("g_cut"),
    ).collect()[0]
    assert r.review_score == 2.5 and r.is_low_review == 0
    assert r.g_sql is None and r.g_cut == "Neutral review (3)"


def test_item_review_fanout_vs_item_grain(spark):
    t = tables(
        spark,
        [order("o1", "c1")],
        [item("o1", 1), item("o1", 2)],
        [review("r1", "o1", 1), review("r2", "o1", 5)],
        [customer("c1", "u1")],
        [product("p1", "cat")],
        [("cat", "category")],
    )
    sql_grain = risk.category_risk(t, min_rows=1).collect()[0]
    assert (sql_grain.items_in_reviewed_orders, sql_grain.avg_review_score, sql_grain.low_review_rate_pct) == (
        4, 3.0, 50.0
    )
    item_grain = risk.category_on_time_risk_item(t, min_items=1).collect()[0]
    assert (item_grain.items_in_on_time_reviewed_orders, item_grain.avg_review_score,
            item_grain.low_review_rate_pct) == (2, 3.0, 0.0)


def test_empty_orphan_and_untranslated_categories(spark):
    t = tables(
        spark,
        [order("o1", "c1")],
        [item("o1", 1, "p_empty"), item("o1", 2, "p_missing"), item("o1", 3, "p_native"), item("o1", 4, "p_en")],
        [review("r1", "o1", 5)],
        [customer("c1", "u1")],
        [product("p_empty", ""), product("p_native", "nativo"), product("p_en", "cama")],
        [("cama", "bed")],
    )
    t["products"] = normalize_empty_strings(t["products"])
    cats = build_mart(t).collect()[0].categories
    assert cats == "bed, nativo, unknown"
    sql_grain = {r.category: r.items_in_reviewed_orders for r in risk.category_risk(t, min_rows=1).collect()}
    assert sql_grain == {"bed": 1, "nativo": 1, "unknown": 2}
    item_grain = {
        r.category: r.items_in_on_time_reviewed_orders for r in risk.category_on_time_risk_item(t, min_items=1).collect()
    }
    assert item_grain == {"bed": 1, "nativo": 1, "unknown": 1}


def test_distinct_sorted_categories(spark):
    t = tables(
        spark,
        [order("o1", "c1")],
        [item("o1", 1, "pb"), item("o1", 2, "pa"), item("o1", 3, "pb")],
        [],
        [customer("c1", "u1")],
        [product("pa", "a"), product("pb", "b")],
    )
    r = build_mart(t).collect()[0]
    assert r.categories == "a, b" and r.item_count == 3


def test_tied_timestamps_broken_by_order_id(spark):
    t = tables(
        spark,
        [order("o2", "c1", bought="2000-01-01 10:00:00"), order("o1", "c2", bought="2000-01-01 10:00:00"),
         order("o3", "c1", bought="2000-02-01 10:00:00")],
        [item("o1", 1), item("o2", 1), item("o3", 1)],
        [review("r1", "o1", 5), review("r2", "o2", 1), review("r3", "o3", 3)],
        [customer("c1", "u1"), customer("c2", "u1")],
        [product("p1", "cat")],
    )
    f = first_reviewed_orders(build_mart(t), "2001-01-01").collect()
    assert len(f) == 1 and f[0].order_id == "o1" and f[0].next_order_id == "o2"


def test_calendar_vs_elapsed_days(spark):
    t = tables(
        spark,
        [order("o1", "c1", bought="2000-01-01 23:00:00"), order("o2", "c1", bought="2000-01-02 01:00:00")],
        [item("o1", 1), item("o2", 1)],
        [review("r1", "o1", 5), review("r2", "o2", 5)],
        [customer("c1", "u1")],
        [product("p1", "cat")],
    )
    f = first_reviewed_orders(build_mart(t), "2001-01-01").collect()[0]
    assert f.days_to_next_order == 1 and f.elapsed_days_to_next_order == 0


def test_unreviewed_first_order_excludes_customer(spark):
    t = tables(
        spark,
        [order("o1", "c1", bought="2000-01-01 10:00:00"), order("o2", "c1", bought="2000-02-01 10:00:00")],
        [item("o1", 1), item("o2", 1)],
        [review("r2", "o2", 5)],
        [customer("c1", "u1")],
        [product("p1", "cat")],
    )
    assert first_reviewed_orders(build_mart(t), "2001-01-01").count() == 0


def test_undelivered_next_order_is_not_a_next_order(spark):
    t = tables(
        spark,
        [order("o1", "c1", bought="2000-01-01 10:00:00"),
         order("o2", "c1", status="shipped", bought="2000-02-01 10:00:00")],
        [item("o1", 1), item("o2", 1)],
        [review("r1", "o1", 5), review("r2", "o2", 5)],
        [customer("c1", "u1")],
        [product("p1", "cat")],
    )
    f = first_reviewed_orders(build_mart(t), "2001-01-01").collect()[0]
    assert f.next_order_id is None and f.has_repeat == 0


def test_cutoff_and_dense_groups(spark):
    t = tables(
        spark,
        [order("o1", "c1", bought="2000-01-01 10:00:00"), order("o2", "c2", bought="2001-01-01 10:00:00")],
        [item("o1", 1), item("o2", 1)],
        [review("r1", "o1", 5), review("r2", "o2", 1)],
        [customer("c1", "u1"), customer("c2", "u2")],
        [product("p1", "cat")],
    )
    rows = retention.retention_timing_elapsed(build_mart(t), "2000-07-01").collect()
    assert [(r.first_order_review_group, r.customers) for r in rows] == [
        ("Low review (1-2)", 0), ("Neutral review (3)", 0), ("High review (4-5)", 1)
    ]
    assert rows[0].repeat_purchase_rate_pct is None


@pytest.mark.parametrize(
    "n,ntile,qcut",
    [(10, [4, 3, 3], [3, 3, 4]), (11, [4, 4, 3], [4, 3, 4]), (12, [4, 4, 4], [4, 4, 4]), (13, [5, 4, 4], [4, 4, 5])],
)
def test_tile_sizes(spark, n, ntile, qcut):
    base = spark.range(n).select((F.col("id") % 3).cast("double").alias("x"), F.col("id").alias("order_id"))
    for method, expected in (("ntile", ntile), ("qcut", qcut)):
        t = add_tiles(base, [F.col("x"), F.col("order_id")], 3, method)
        sizes = {r.tile: r["count"] for r in t.groupBy("tile").count().collect()}
        assert [sizes.get(i, 0) for i in (1, 2, 3)] == expected


def test_case_insensitive_collation_groups_keys(spark):
    from ordersight.sources.readers import apply_collation

    t = tables(
        spark,
        [order("o1", "c1"), order("o2", "c2")],
        [item("o1", 1), item("o2", 1)],
        [review("r1", "o1", 5), review("r2", "o2", 1)],
        [customer("c1", "u1", "SP"), customer("c2", "u2", "sp")],
        [product("p1", "cat")],
    )
    binary = descriptive.region_reviews(build_mart(t), min_orders=1).count()
    folded = {k: apply_collation(v, "UTF8_LCASE") for k, v in t.items()}
    ci = descriptive.region_reviews(build_mart(folded), min_orders=1).collect()
    assert binary == 2 and len(ci) == 1 and ci[0].orders == 2


def test_exact_half_up_rounding(spark):
    from ordersight.functions.columns import rate_pct, round_half_up, round_ratio

    df = spark.createDataFrame([(107, 40), (1, 8), (1, 3), (5, 2), (0, 0)], "n long, d long")
    rows = df.select(
        round_ratio("n", "d", 2).alias("r2"), rate_pct("n", "d").alias("pct"), round_ratio("n", "d", 0).alias("r0")
    ).collect()
    # 107/40 = 2.675 exactly: half up gives 2.68 (a binary double of 2.675 would round down).
    assert [r.r2 for r in rows] == [2.68, 0.13, 0.33, 2.5, None]
    assert [r.pct for r in rows] == [267.5, 12.5, 33.33, 250.0, None]
    assert [r.r0 for r in rows] == [3.0, 0.0, 0.0, 3.0, None]
    assert spark.range(1).select(round_half_up(F.lit(-0.0004), 3).alias("x")).first().x == 0.0
