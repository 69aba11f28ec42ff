"""Benjamini-Hochberg false-discovery-rate adjustment.

    adjusted p_(i) = min_{j >= i} p_(j) * m / j, capped at 1
    reject          = adjusted p <= alpha   (same set as the step-up rule)

A table of tests that is bounded by a key dimension (``bounded=True``; categories, states)
folds into one sorted array: one aggregate, no sort of the table and no checkpoint.
For any other number of tests both steps are distributed: the ranks come from range-sorted global positions
and the minimum over all later ranks is a running minimum in descending rank
order, carried across range partitions by their per-partition minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.operators.tiles import global_ranks, global_running


def _bounded(tests: DataFrame, p_col: str, key_col: str) -> DataFrame:
    row = F.struct(*tests.columns)
    one = tests.agg(F.sort_array(F.collect_list(F.struct(F.col(p_col).alias("p"), F.col(key_col).alias("key"), row.alias("row")))).alias("s"))
    m = F.size("s")
    raw = F.transform("s", lambda x, i: x["p"] * m / (i + 1))
    # running minimum from the largest p-value down; the entry in front is a start value
    down = F.aggregate(
        F.reverse(raw), F.array(F.lit(1.0)), lambda acc, x: F.concat(F.array(F.least(F.element_at(acc, 1), x)), acc)
    )
    adjusted = one.withColumn("adj", down).select(F.explode(F.arrays_zip("s", "adj")).alias("z")).where(F.col("z.s").isNotNull())
    return adjusted.select("z.s.row.*", F.col("z.adj").alias("p_adjusted"))


def benjamini_hochberg(tests: DataFrame, p_col: str, key_col: str, alpha: float = 0.05, bounded: bool = False) -> DataFrame:
    """Add ``p_adjusted`` and ``reject``; ``key_col`` breaks ties between equal p-values."""
    if bounded:
        return _bounded(tests, p_col, key_col).withColumn("reject", F.col("p_adjusted") <= F.lit(alpha))
    ranked = global_ranks(tests, [F.col(p_col).asc(), F.col(key_col).asc()], "_i", "_m")
    ranked = ranked.withColumn("_raw", F.col(p_col) * F.col("_m") / F.col("_i"))
    adj = global_running(ranked, [F.col("_i").desc()], ["_raw"], "min", prefix="_min")
    return (
        adj.withColumn("p_adjusted", F.least(F.col("_min_raw"), F.lit(1.0)))
        .withColumn("reject", F.col("p_adjusted") <= F.lit(alpha))
        .drop("_i", "_m", "_raw", "_min_raw")
    )
