"""Plan lint: scale properties of every registered analysis."""

from __future__ import annotations

import contextlib
import io

import pytest

import __spark_entry__ as entry
from conftest import SF001, SF01
from ordersight.plans.registry import QUERIES

#: rows that one task may receive: offsets per partition, counts per group, top-k lists
FEW_ROWS = 1_000


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_pairwise_joins(spark, name):
    text = plan_text(entry.queries()[name](spark, SF001))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def _single_partition_rows(plan) -> list[int]:
    """Rows sent to each single-partition exchange of an executed plan."""
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage", "TableCacheQueryStage"):
            todo.append(node.plan())
            continue
        if name == "Exchange" and "SinglePartition" in node.outputPartitioning().toString():
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_one_task_receives_few_rows(spark, name):
    """Global aggregates and windows without keys see pre-aggregated rows only, whatever the table's size."""
    df = QUERIES[name](spark, SF01)
    df.collect()
    assert all(n <= FEW_ROWS for n in _single_partition_rows(df._jdf.queryExecution().executedPlan()))


def test_single_partition_rows_are_seen(spark):
    """The check above does see a window without keys over a whole table."""
    df = spark.read.parquet(f"{SF01}/orders.parquet").selectExpr("row_number() OVER (ORDER BY o_orderkey) AS n", "o_orderkey")
    df.collect()
    assert max(_single_partition_rows(df._jdf.queryExecution().executedPlan())) > FEW_ROWS


def test_first_order_window_is_limited_before_the_shuffle(spark):
    text = plan_text(entry.queries()["repeat_purchase"](spark, SF001))
    assert text.count("WindowGroupLimit") >= 2


def test_views_run_sql(spark):
    from ordersight.plans.views import register_views

    names = register_views(spark, SF001)
    assert "mart_order_fact" in names
    rows = spark.sql(
        """
        SELECT customer_state, COUNT(*) AS orders
        FROM mart_order_fact
        WHERE order_status = 'delivered' AND review_score IS NOT NULL
          AND customer_state IN (SELECT customer_state FROM raw_customers GROUP BY customer_state)
        GROUP BY customer_state
        """
    ).collect()
    assert len(rows) == 25 and sum(r.orders for r in rows) > 0
