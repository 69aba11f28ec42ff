"""Every registered analysis against its DuckDB oracle (order-insensitive)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from conftest import SF001, SF01
from oracle_check import canon, duck, type_mismatches

KEYS = sorted(entry.oracle_sql())
# Keys with a statistic that depends on the data volume are also checked at sf0.01.
SF01_KEYS = ["mart_order_fact", "category_risk", "seller_on_time_risk", "freight_terciles", "test_h12_seller"]


@pytest.fixture(scope="module")
def con001():
    return duck(SF001)


@pytest.fixture(scope="module")
def con01():
    return duck(SF01)


def _check(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    got = df.toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert not type_mismatches(df, con, entry.oracle_sql()[name])
    assert len(got) == len(want)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", KEYS)
def test_oracle_sf0001(spark, con001, name):
    _check(spark, con001, SF001, name)


@pytest.mark.parametrize("name", SF01_KEYS)
def test_oracle_sf001(spark, con01, name):
    _check(spark, con01, SF01, name)


def test_rows_only_keys_run(spark):
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        assert entry.queries()[name](spark, SF001).count() > 0


def test_entry_smoke(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 4
    assert [r.delivery_bucket for r in rows] == ["On time or early", "1-3 days late", "4-7 days late", "8+ days late"]
