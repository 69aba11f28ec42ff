"""Tiny literal raw tables exercising the semantic decisions (FIXTURES.md §5)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from ordersight.schemas import RAW_SCHEMAS


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def tables(spark, orders, items=(), reviews=(), customers=(), products=(), translation=()):
    def make(name, rows):
        return spark.createDataFrame(list(rows), RAW_SCHEMAS[name])

    return {
        "orders": make("orders", orders),
        "order_items": make("order_items", items),
        "order_reviews": make("order_reviews", reviews),
        "customers": make("customers", customers),
        "products": make("products", products),
        "category_translation": make("category_translation", translation),
    }


def order(oid, cust, status="delivered", bought="2018-01-01 10:00:00", delivered="2018-01-05 10:00:00",
          estimated="2018-01-10 00:00:00"):
    return (oid, cust, status, ts(bought) if bought else None, ts(delivered) if delivered else None,
            ts(estimated) if estimated else None)


def item(oid, n, product="p1", seller="s1", price="10.00", freight="1.00"):
    return (oid, n, product, seller, None, Decimal(price), Decimal(freight))


def review(rid, oid, score):
    return (rid, oid, score, None, None)


def customer(cid, uid, state="SP"):
    return (cid, uid, None, None, state)


def product(pid, category):
    return (pid, category, None, None, None, None, None, None, None)
