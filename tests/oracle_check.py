"""Spark result vs DuckDB oracle, order-insensitive (mirrors the driver's check).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    import decimal

    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return None
        return round(f, 9)
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


# Spark simpleString -> DuckDB type name considered the same column type.
TYPE_PAIRS = {
    ("int", "INTEGER"),
    ("bigint", "BIGINT"),
    ("double", "DOUBLE"),
    ("string", "VARCHAR"),
    ("timestamp_ntz", "TIMESTAMP"),
    ("boolean", "BOOLEAN"),
    ("decimal(38,2)", "DECIMAL(38,2)"),
}


def type_mismatches(spark_df, con, sql: str) -> dict[str, tuple]:
    """Columns whose Spark and DuckDB types differ (by the pairs above)."""
    stypes = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    rel = con.sql(sql)
    dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    return {
        c: (stypes.get(c), dtypes.get(c))
        for c in sorted(set(stypes) | set(dtypes))
        if (stypes.get(c), dtypes.get(c)) not in TYPE_PAIRS
    }


def canon(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict[str, str]:
    import __spark_entry__ as e

    qs, sqls = e.queries(), e.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            spark_df = qs[name](spark, sf_dir)
            sdf = spark_df.toPandas()
        except Exception as ex:  # pragma: no cover - reported
            results[name] = f"SPARK ERROR {type(ex).__name__}: {str(ex)[:300]}"
            print(name, results[name])
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = f"rows-only ({len(sdf)} rows)"
            print(f"{name:40s} {results[name]}  {ts:.1f}s")
            continue
        try:
            odf = con.execute(sqls[name]).df()
        except Exception as ex:
            results[name] = f"SQL ERROR {str(ex)[:300]}"
            print(name, results[name])
            continue
        status = "OK"
        types = type_mismatches(spark_df, con, sqls[name])
        if sorted(sdf.columns) != sorted(odf.columns):
            status = f"COLUMNS spark={sorted(sdf.columns)} oracle={sorted(odf.columns)}"
        elif len(sdf) != len(odf):
            status = f"ROWS spark={len(sdf)} oracle={len(odf)}"
        else:
            a, b = canon(sdf), canon(odf)
            if a != b:
                diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
                status = f"VALUES differ e.g. {diffs}"
            elif types:
                status = f"TYPES differ {types}"
        results[name] = status
        if verbose:
            print(f"{name:40s} {status[:600]}  rows={len(sdf)} {ts:.1f}s")
    return results


if __name__ == "__main__":
    from ordersight.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if not (v == "OK" or v.startswith("rows-only"))}
    print(f"\n{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("FAIL", k, v[:300])
