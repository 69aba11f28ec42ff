"""Shared inputs of the analyses: raw tables and the order mart per data location.

Several analyses share the mart, so it is materialised once per session and
location, in one of two ways:

- ``persist`` (default): memory, spilling to disk.  A lost executor only drops
  cached blocks, which Spark recomputes from the lineage.
- ``table``: written as Parquet under the shared ``spark.checkpoint.dir`` and
  read back.  Lineage is cut, lost executors cost nothing, and later scans get
  column pruning and filter pushdown - the better choice for very large inputs.

Analyses that read the mart once and need few of its columns take ``facts``: the same rows,
not materialised, so that Spark prunes the aggregates and one-to-one joins whose columns
nobody reads.  Where the mart is persisted already, its blocks are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ordersight.operators.mart import build_mart
from ordersight.operators.shared import register_anchor, release_anchor
from ordersight.session import ensure_checkpoint_dir
from ordersight.sources.readers import load_raw_tables

_CACHE: dict[tuple, "Workspace"] = {}

# Raw tables worth keeping: they are derived by aggregation/joins in the adapter
# and read by many analyses.  Items are a plain projection of a Parquet scan.
_PERSISTED_RAW = ("orders", "order_reviews", "customers", "category_translation")


@dataclass
class Workspace:
    spark: SparkSession
    location: str
    source: str = "testdata"
    persist: bool = True
    materialize: str = "persist"
    collation: str | None = None
    isolate_hot: bool = False
    state: str = ""
    _raw: dict | None = field(default=None, repr=False)
    _mart: DataFrame | None = field(default=None, repr=False)
    _facts: DataFrame | None = field(default=None, repr=False)

    @property
    def raw(self) -> dict[str, DataFrame]:
        if self._raw is None:
            raw = load_raw_tables(self.spark, self.source, self.location, self.collation)
            if self.persist:
                for name in _PERSISTED_RAW:
                    raw[name] = raw[name].persist(StorageLevel.MEMORY_AND_DISK)
                register_anchor(raw)
            self._raw = raw
        return self._raw

    @property
    def mart(self) -> DataFrame:
        if self._mart is None:
            mart = build_mart(self.raw, self.isolate_hot)
            if self.persist:
                mart = self._materialize(mart, "mart_order_fact")
                register_anchor(mart)
            self._mart = mart
        return self._mart

    @property
    def facts(self) -> DataFrame:
        """The mart's rows, computed as far as their columns are read; grains of it are shared."""
        # salted joins and stored tables are built eagerly: once is enough
        if self.isolate_hot or not self.persist or self.materialize != "persist":
            return self.mart
        if self._facts is None:
            self._facts = build_mart(self.raw)
            register_anchor(self._facts)
        return self._facts

    def release(self) -> None:
        """Unpersist the mart, the persisted raw tables and every shared grain."""
        if self._facts is not None:
            release_anchor(self._facts)
            self._facts = None
        if self._mart is not None:
            release_anchor(self._mart)
            self._mart.unpersist()
            self._mart = None
        if self._raw is not None:
            release_anchor(self._raw)
            for df in self._raw.values():
                df.unpersist()
            self._raw = None

    def _materialize(self, df: DataFrame, name: str) -> DataFrame:
        if self.materialize == "table":
            base = ensure_checkpoint_dir(self.spark).rstrip("/")
            app = self.spark.sparkContext.applicationId
            key = "|".join(str(x) for x in (self.location, self.source, self.collation, self.state))
            digest = hashlib.sha256(key.encode()).hexdigest()[:16]
            path = f"{base}/ordersight-tables/{app}/{digest}/{name}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)
        return df.persist(StorageLevel.MEMORY_AND_DISK)


def fingerprint(spark: SparkSession, location: str) -> str:
    """Digest of the names, sizes and modification times of the files at a location ('' if it is no path).

    Listed through the cluster's file system, from the driver: metadata only.
    """
    sc = spark.sparkContext
    try:
        path = sc._jvm.org.apache.hadoop.fs.Path(location)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return ""
        files = fs.listFiles(path, True)
    except Py4JJavaError:  # not a path: a database url, a table prefix
        return ""
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def workspace(
    spark: SparkSession,
    location: str,
    source: str = "testdata",
    persist: bool = True,
    materialize: str = "persist",
    collation: str | None = None,
    isolate_hot: bool = False,
) -> Workspace:
    """The workspace of a location.  When its files have changed since it was built, its tables
    and grains are released and built anew from the files as they are now."""
    key = (id(spark), spark.sparkContext.applicationId, location, source, persist, materialize, collation, isolate_hot)
    state = fingerprint(spark, location)
    ws = _CACHE.get(key)
    if ws is not None and ws.state != state:
        _CACHE.pop(key).release()
        ws = None
    if ws is None:
        # cached listings of changed files would hide them
        if state:
            spark.catalog.refreshByPath(location)
        ws = Workspace(spark, location, source, persist, materialize, collation, isolate_hot, state)
        _CACHE[key] = ws
    return ws


def release_workspaces(spark: SparkSession) -> int:
    """Release every workspace of ``spark``; returns how many were released."""
    keys = [k for k, ws in _CACHE.items() if ws.spark is spark]
    for k in keys:
        _CACHE.pop(k).release()
    return len(keys)
