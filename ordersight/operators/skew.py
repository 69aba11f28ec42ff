"""Joins on keys that may hold a large share of the rows.

A hash join sends all rows of a key to one task.  Here the heavy keys are found
first by a partial aggregate over the key column alone: a key is heavy when it holds more
rows than ``factor`` average partitions.  There can be no more than partitions / factor
of them, so their table is small whatever the data's size and is broadcast on that bound.
Rows with a heavy key are dealt over ``FINENESS`` slices for every average partition that the
key fills, fine enough to even out slices that meet in one partition; the matching rows of the other side, unique per key, are repeated once per
slice.  All other rows stay in slice 0, and one join on (key, slice) serves both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Slices per average partition that a heavy key fills.
FINENESS = 4


def heavy_keys(rows: DataFrame, key: str, partitions: int | None = None, factor: float = 0.5) -> DataFrame:
    """(key, slices) of the keys that hold more rows than ``factor`` average partitions."""
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # the limit keeps the bound explicit: no more keys can exceed their share
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    average = total.select((F.col("total") / F.lit(float(partitions))).alias("a")).first()["a"]
    heavy = counts.where(F.col("n") > F.lit(factor * average)).limit(int(partitions / factor) + 1)
    return heavy.select(F.col(key).alias("heavy_key"), F.ceil(F.lit(FINENESS) * F.col("n") / F.lit(max(average, 1.0))).cast("int").alias("slices"))


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: str,
    how: str = "left",
    partitions: int | None = None,
    factor: float = 0.5,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """``rows`` joined with ``lookup`` (unique per key) on ``key``, heavy keys dealt over slices.

    ``spread_by`` is a column of ``rows`` that varies within a key; ``how`` is "left" or "inner".
    ``keys_from`` is a cheaper table with the same keys as ``rows``, to count them in.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type {how!r}")
    heavy = heavy_keys(rows if keys_from is None else keys_from, key, partitions, factor).checkpoint()
    slices = F.coalesce(F.col("slices"), F.lit(1))
    left = rows.join(F.broadcast(heavy), rows[key] == F.col("heavy_key"), "left")
    left = left.withColumn("_slice", F.pmod(F.xxhash64(spread_by), slices).cast("int")).drop("heavy_key", "slices")
    right = lookup.join(F.broadcast(heavy), lookup[key] == F.col("heavy_key"), "left")
    right = right.withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("heavy_key", "slices")
    return left.join(right, [key, "_slice"], how).drop("_slice")
