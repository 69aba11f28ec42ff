"""Analyses compute what they read: no aggregates nobody asks for, no whole splits of keys in one task."""

from __future__ import annotations

import os
import tempfile

from fixtures import customer, item, order, product, review, tables
from ordersight.plans import retention
from ordersight.plans.context import release_workspaces, workspace
from ordersight.sources.sinks import write_table_parquet
from test_plans import plan_text

CUTOFF = "2019-01-01"


def _stored_tables(spark) -> str:
    raw = tables(
        spark,
        [
            order("o1", "c1", bought="2018-01-01 10:00:00"),
            order("o2", "c2", bought="2018-01-04 09:00:00"),
            order("o3", "c3", bought="2018-02-01 10:00:00"),
            order("o4", "lost", bought="2018-02-01 10:00:00"),
        ],
        [item("o1", 1), item("o1", 2, seller="s2"), item("o3", 1, product="p2")],
        [review("r1", "o1", 1), review("r2", "o3", 5), review("r3", "o3", 4), review("r4", "o4", 3)],
        [customer("c1", "u1"), customer("c2", "u1"), customer("c3", "u3")],
        [product("p1", "toys")],
    )
    folder = tempfile.mkdtemp(prefix="ordersight-scale-")
    for name, df in raw.items():
        write_table_parquet(df, os.path.join(folder, name))
    return folder


def test_first_order_analyses_leave_items_and_products_out(spark):
    ws = workspace(spark, _stored_tables(spark), "parquet")
    text = plan_text(retention.retention_timing(ws.facts, CUTOFF))
    assert "review_score" in text and "freight_value" not in text and "product_category_name" not in text
    release_workspaces(spark)


def test_facts_are_the_marts_rows(spark):
    ws = workspace(spark, _stored_tables(spark), "parquet")
    lean = [tuple(r) for r in retention.retention_timing(ws.facts, CUTOFF).collect()]
    facts = sorted(map(str, ws.facts.collect()))
    assert facts == sorted(map(str, ws.mart.collect())) and len(facts) == 3
    assert lean == [tuple(r) for r in retention.retention_timing(ws.mart, CUTOFF).collect()]
    # u1 came back after three days, u3 did not
    assert [(r[0][:4], r[1], r[2], float(r[4]) if r[4] is not None else None) for r in lean] == [("Low ", 1, 1, 3.0), ("High", 1, 0, None)]
    release_workspaces(spark)
    again = workspace(spark, ws.location, "parquet")
    assert again is not ws and again.facts.count() == 3
    release_workspaces(spark)


def test_registered_first_order_queries_do_not_build_the_whole_mart(spark):
    from conftest import SF001
    from ordersight.plans.registry import QUERIES

    release_workspaces(spark)
    for name in ("retention_timing", "repeat_purchase", "dq_granularity"):
        assert "l_extendedprice" not in plan_text(QUERIES[name](spark, SF001)), name


def test_keys_are_dealt_before_they_are_collected(spark, monkeypatch):
    """Map tasks send keys on; each reducer holds a bounded number, and rows without a key spread out."""
    from ordersight.plans import quality

    monkeypatch.setattr(quality, "KEYS_A_TASK", 10)
    df = spark.range(100).selectExpr("if(id < 60, id div 2, null) AS a", "cast(id % 2 AS string) AS b")
    counts = quality._key_counts(df, ["a", "b"], 100)
    assert tuple(counts.first()) == (100, 40, 60)
    assert tuple(quality._key_counts(df, ["a"], 100).first()) == (100, 40, 30)
    assert tuple(quality._key_counts(df.where("a < 0"), ["a"], 0).first()) == (0, 0, 0)
    physical = plan_text(counts).split("\n\n")[0]
    below = physical[physical.index("Exchange", physical.index("Exchange") + 1) :]
    assert "Aggregate" not in below  # nothing is collected before the rows are dealt by key
    parts = counts.sparkSession.createDataFrame([(None,)] * 40, "a int")
    assert tuple(quality._key_counts(parts, ["a"], 40).first()) == (40, 40, 0)


def test_key_uniqueness_deals_every_table(spark):
    from ordersight.plans import quality

    raw = workspace(spark, _stored_tables(spark), "parquet")
    found = quality.dq_key_uniqueness(raw.raw, raw.facts)
    assert plan_text(found).split("\n\n(1)")[0].count("Exchange") >= 12
    rows = {r.table_name: (r.all_rows, r.null_keys, r.unique_keys, r.duplicate_rows) for r in found.collect()}
    assert rows["mart_order_fact"] == (3, 0, 3, 0) and rows["raw_order_items"] == (3, 0, 3, 0)
    release_workspaces(spark)
