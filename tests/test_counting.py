"""Order statistics, medians, tails and test counts against their definitions; plan shapes of the tests."""

from __future__ import annotations

import math
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF001
from fixtures import customer, item, order, review, tables
from ordersight.functions import tails
from ordersight.operators import selection
from ordersight.operators.contingency import chi2_two_column
from ordersight.operators.fdr import benjamini_hochberg
from ordersight.operators.mart import build_mart
from ordersight.operators.ranks import group_medians
from ordersight.operators.tiles import add_tiles
from ordersight.plans import descriptive, hypotheses, quality
from ordersight.plans.registry import QUERIES
from test_plans import plan_text


@pytest.mark.parametrize("key_type", ["long", "string"])
def test_rows_at_positions(spark, monkeypatch, key_type):
    """A third of the rows share one value, another many near values; every narrowing step is needed."""
    monkeypatch.setattr(selection, "FEW", 5)
    monkeypatch.setattr(selection, "ACCURACY", 50)
    rng = random.Random(2)
    keys = rng.sample(range(10**7), 1500)
    name = (lambda k: f"order-{k:08d}") if key_type == "string" else int
    rows = [(0.25 if i % 3 == 0 else rng.choice([rng.random(), 1e9 * rng.random(), -0.5]), name(k)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, f"x double, k {key_type}").repartition(5)
    want = sorted(rows)
    places = [1, 2, 500, 501, 750, 999, 1499, 1500]
    cols = [F.col("x"), F.col("k")]
    n, got = selection.rows_at(df, cols, lambda n: {str(p): (p / 1500, p) for p in places})
    assert n == 1500 and got == {str(p): want[p - 1] for p in places}
    assert selection.rows_at(df.limit(0), cols, lambda n: {"a": (0.5, n // 2)}) == (0, {})
    later = {tuple(r) for r in df.where(selection.after(cols, want[749])).collect()}
    assert later == set(want[750:])


def test_tiles_with_string_keys_and_many_equal_values(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 4)
    rows = [(float(i % 2), f"{i:05d}-{'x' * 20}") for i in range(301)]
    df = spark.createDataFrame(rows, "x double, k string")
    pos = {r: i + 1 for i, r in enumerate(sorted(rows))}
    q = pd.qcut(pd.Series(range(1, 302)), 3, labels=[1, 2, 3]).astype(int).tolist()
    for method, tile in (("qcut", lambda p: q[p - 1]), ("ntile", lambda p: 1 if p <= 101 else 2 if p <= 201 else 3)):
        got = add_tiles(df, [F.col("x"), F.col("k")], 3, method).collect()
        assert all(r.tile == tile(pos[(r.x, r.k)]) for r in got)


def test_group_medians(spark):
    rng = random.Random(4)
    # as many values as rows in one group; even, odd, single and NULL groups
    groups = {"a": [rng.random() for _ in range(400)], "b": [3.0, 1.0, 2.0], "c": [5.0], None: [1.0, 4.0], "d": [2.0, 2.0, 9.0, 9.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("b", None), ("empty", None)]
    got = group_medians(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()
    assert {r.g: (r.median, r.n) for r in got} == {g: (statistics.median(v), len(v)) for g, v in groups.items()}


def test_native_tails(spark):
    ks = (1, 2, 3, 4, 7, 24, 99, 500, 999)
    rows = [(x, float(k)) for k in ks for x in (0.0, 1e-6, 0.5, 2.9, 3.1, 17.0, 0.5 * k, 0.99 * k, 1.0 * k, 1.2 * k, 3.0 * k, 20000.0)]
    rows += [(None, 1.0), (1.0, None), (float("nan"), 2.0), (-1.0, 3.0), (3.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, k double")
    for r in df.select("*", tails.chi2_tail("x", "k").alias("p"), tails.normal_two_sided("x").alias("z")).collect():
        want = tails.chi2_sf(r.x, r.k)
        assert (r.p is None) if math.isnan(want) else math.isclose(r.p, want, rel_tol=1e-9, abs_tol=1e-300), r
        if r.x is not None and r.x >= 0:
            assert math.isclose(r.z, tails.two_sided_from_cdf(r.x), abs_tol=1e-15)
    mw = [(10.0, 5.0, 7.0, 0.0), (17.5, 5.0, 7.0, 12.0), (284412.0, 317.0, 2124.0, 5000.0), (4.5, 3.0, 3.0, 0.0)]
    empty = [(3.0, 0.0, 5.0, 0.0), (None, 1.0, 2.0, 3.0), (2.0, 2.0, 2.0, 60.0)]
    p = tails.mann_whitney_tail(*"uabt")
    df = spark.createDataFrame(mw + empty, "u double, a double, b double, t double")
    got = {(r.u, r.a): r.p for r in df.select("*", p.alias("p")).collect()}
    assert all(math.isclose(got[(m[0], m[1])], tails.mann_whitney_p(*m), rel_tol=1e-9) for m in mw)
    assert all(got[(m[0], m[1])] is None for m in empty)


def test_bounded_fdr_equals_the_distributed_one(spark):
    rng = random.Random(6)
    rows = [(f"k{i}", rng.choice([0.0, 1.0, 0.01, rng.random() ** 3]), i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, p double, other int")
    one = {r.k: (r.p_adjusted, r.reject, r.other) for r in benjamini_hochberg(df, "p", "k", bounded=True).collect()}
    two = {r.k: (r.p_adjusted, r.reject, r.other) for r in benjamini_hochberg(df, "p", "k").collect()}
    assert one == two and len(one) == 40
    assert benjamini_hochberg(df.limit(0), "p", "k", bounded=True).count() == 0


def test_chi2_over_many_arrays(spark):
    rng = random.Random(8)
    big = 10**9
    for rows in (
        [(i, big + rng.randrange(1000), big + rng.randrange(1000)) for i in range(500)],
        [(1, 30, 10), (2, 25, 35)],
        [(1, 5, 0), (2, 6, 0)],
        [(1, 0, 0)],
        [],
    ):
        df = spark.createDataFrame(rows, "row int, o0 long, o1 long")
        one, many = chi2_two_column(df).first(), chi2_two_column(df, buckets=16).first()
        for name in ("n", "rows", "cols", "dof", "chi2", "cramers_v"):
            assert one[name] == many[name] or math.isclose(one[name], many[name], rel_tol=1e-9), (name, one, many)


def test_elapsed_and_calendar_delays_differ_off_midnight(spark):
    """Estimate at 18:00, delivery the next day at 09:00: one calendar day late, none elapsed."""
    raw = tables(
        spark,
        [order("o1", "c1", delivered="2018-01-11 09:00:00", estimated="2018-01-10 18:00:00"), order("o2", "c1")],
        [item("o1", 1), item("o2", 1)],
        [review("r1", "o1", 1), review("r2", "o2", 5)],
        [customer("c1", "u1")],
    )
    mart = build_mart(raw)
    calendar = {r.delivery_bucket: r.orders for r in descriptive.delay_bucket_reviews(mart).collect()}
    assert calendar == {"On time or early": 1, "1-3 days late": 1}
    elapsed = {r.delay_bucket: (r.not_low_orders, r.low_orders) for r in descriptive.h1_rate_table(mart).collect()}
    assert elapsed == {"On time or early": (1, 1)}
    assert hypotheses.h1_stats(mart).first()["rows"] == 1


def test_null_keys_are_counted_apart(spark):
    raw = tables(
        spark,
        [order("o1", "c1"), order("o1", "c1"), order("none", "c1"), order("none", "c1")],
        [item("o1", 1), item("o1", 1), item("o1", 0), item("none", 2)],
    )
    for name in ("orders", "order_items"):
        raw[name] = raw[name].withColumn("order_id", F.nullif("order_id", F.lit("none")))
    raw["order_items"] = raw["order_items"].withColumn("order_item_id", F.nullif("order_item_id", F.lit(0)))
    got = {r.table_name: (r.all_rows, r.null_keys, r.unique_keys, r.duplicate_rows) for r in quality.dq_key_uniqueness(raw, build_mart(raw)).collect()}
    assert got["raw_orders"] == (4, 2, 1, 1)
    assert got["raw_order_items"] == (4, 2, 1, 1)
    assert got["raw_customers"] == (0, 0, 0, 0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_analyses_run_without_python_workers(spark, name):
    text = plan_text(QUERIES[name](spark, SF001))
    assert not any(node in text for node in ("ArrowEvalPython", "BatchEvalPython", "InPandas", "InArrow"))


def test_tests_read_the_fact_table_once(spark):
    raw = tables(spark, [order("o1", "c1")], [item("o1", 1)], [review("r1", "o1", 1)], [customer("c1", "u1")])
    mart = build_mart(raw).cache()
    try:
        for stats in (hypotheses.test_h1_delay(mart), hypotheses.test_h6_freight(mart), hypotheses.test_h5_state(mart)):
            text = plan_text(stats)
            assert text.count("Scan In-memory table") + text.count("InMemoryTableScan") <= 3 and "Subquery" not in text
            physical = text.split("\n\n")[0]
            assert physical.count("InMemoryTableScan") == 1, physical
    finally:
        mart.unpersist()


@pytest.mark.parametrize("name", ["freight_terciles", "freight_terciles_qcut", "freight_late_crosstab", "freight_late_crosstab_pretiled"])
def test_terciles_do_not_sort_the_population(spark, name):
    physical = plan_text(QUERIES[name](spark, SF001)).split("\n\n")[0]
    physical = physical.split("InMemoryRelation")[0]  # without the stored fact table's own plan
    # one range sort: that of the result's few rows
    assert physical.count("Sort") <= 1 and "Window" not in physical


@pytest.mark.parametrize(
    "name, columns, key",
    [
        ("delay_bucket_reviews", ["delivery_bucket"], lambda r: ["On time or early", "1-3 days late", "4-7 days late", "8+ days late"].index(r[0])),
        ("dq_status_mix", ["orders", "order_status"], lambda r: (-r[0], r[1])),
        ("dq_score_distribution", ["review_score"], lambda r: r[0]),
        ("region_late_stratified", ["customer_state", "delivery_status"], lambda r: r),
        ("category_risk", ["low_review_rate_pct", "category"], lambda r: -r[0]),
        ("order_complexity", ["low_review_rate_pct", "item_complexity"], lambda r: (-r[0], r[1])),
        ("freight_terciles", ["freight_ratio_tercile"], lambda r: r[0]),
        ("h1_rate_table", ["delay_bucket"], lambda r: ["On time or early", "1-3 days late", "4-7 days late", "8+ days late"].index(r[0])),
    ],
)
def test_results_come_in_the_published_order(spark, name, columns, key):
    rows = [tuple(r[c] for c in columns) for r in entry.queries()[name](spark, "/root/testdata/sf0.01").collect()]
    assert len(rows) > 1 and rows == sorted(rows, key=key)
