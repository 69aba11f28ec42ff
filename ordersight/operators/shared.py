"""Reuse of intermediate grains across analyses.

Many analyses start from the same order-level intermediates (per-order review
sums, per-(order, category) item counts, the order-seller grain, the first two
orders of each customer).  When their input belongs to a workspace that
persists its tables, the intermediate is built once and persisted (memory,
spilling to disk); otherwise it is simply built.  Persisted blocks lost with
an executor are recomputed from lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_ANCHORS: dict[int, object] = {}
_MEMO: dict[tuple[int, str], DataFrame] = {}
_VALUES: dict[tuple[int, str], object] = {}


def register_anchor(obj: object) -> None:
    """Mark ``obj`` (a raw-table dict or a persisted mart) as long-lived."""
    _ANCHORS[id(obj)] = obj


def shared(anchor: object, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` once per long-lived ``anchor`` and persist it; plain ``build()`` otherwise."""
    if _ANCHORS.get(id(anchor)) is not anchor:
        return build()
    k = (id(anchor), key)
    df = _MEMO.get(k)
    if df is None:
        df = build().persist(StorageLevel.MEMORY_AND_DISK)
        _MEMO[k] = df
    return df


def remembered(anchor: object, key: str, find: Callable[[], object]) -> object:
    """A few plain values (such as the rows at tile cuts) found once per long-lived ``anchor``."""
    if _ANCHORS.get(id(anchor)) is not anchor:
        return find()
    k = (id(anchor), key)
    if k not in _VALUES:
        _VALUES[k] = find()
    return _VALUES[k]


def release_anchor(anchor: object) -> int:
    """Unpersist every intermediate built for ``anchor`` and forget it; returns the count."""
    keys = [k for k in _MEMO if k[0] == id(anchor)]
    for k in keys:
        _MEMO.pop(k).unpersist()
    for k in [k for k in _VALUES if k[0] == id(anchor)]:
        del _VALUES[k]
    _ANCHORS.pop(id(anchor), None)
    return len(keys)
