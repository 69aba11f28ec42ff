"""Exact global tiles and running aggregates without a single-partition window.

``NTILE(k) OVER (ORDER BY x)`` with no PARTITION BY makes Spark move every row
into one partition.  A tile only depends on where its last row lies, so the k - 1
rows at the cuts are selected by counting (``operators.selection``) and a row's tile is a
comparison with them: no sort, no shuffle and no copy of the data.  One selection
serves both rules:

- ``ntile``: SQL NTILE - the first ``n mod k`` tiles get one extra row;
- ``qcut``: pandas ``qcut(rank(method="first"), k)`` - row ``r`` falls after the
  cut ``ceil(j * (n - 1) / k)``.  This closed form reproduces pandas' edge
  computation, including its floating-point behaviour when ``(n - 1)`` is a
  multiple of ``k``; checked for k = 3.

Running sums and minima over a global order (mid-ranks of the rank tests, medians, the
Benjamini-Hochberg adjustment) run over histograms and tables of tests:

1. ``orderBy(keys)`` - a range-partitioned sort of the histogram.
2. ``monotonically_increasing_id`` right after the sort encodes
   ``(partition index << 33) + position inside the partition``.
3. The result is checkpointed (reliable storage under ``spark.checkpoint.dir``)
   so the positions are fixed once, even if executors are lost later.
4. Per-partition totals (one row per partition) -> running offsets via a
   window over that small table -> broadcast back on the partition index.
   The broadcast side has one row per partition: its size is bounded by the
   partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.operators.selection import after, rows_at
from ordersight.session import ensure_checkpoint_dir

_POS_BITS = 33


def global_ranks(df: DataFrame, order_cols: list[str | Column], rank_col: str = "_rank", total_col: str = "_total"):
    """Add the exact 1-based position of each row in ``order_cols`` order and the row count."""
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    ordered = ordered.checkpoint(eager=True)
    pos = ordered.withColumn("_pid", F.shiftright("_mid", _POS_BITS)).withColumn(
        "_loc", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    )
    counts = pos.groupBy("_pid").agg((F.max("_loc") + 1).alias("_cnt"))
    by_pid = Window.orderBy("_pid")
    everything = by_pid.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "_pid",
        (F.sum("_cnt").over(by_pid) - F.col("_cnt")).alias("_off"),
        F.sum("_cnt").over(everything).alias(total_col),
    )
    ranked = pos.join(F.broadcast(offsets), "_pid").withColumn(rank_col, F.col("_off") + F.col("_loc") + 1)
    return ranked.drop("_mid", "_pid", "_loc", "_off")


def global_running(
    df: DataFrame,
    order_cols: list[str | Column],
    value_cols: list[str],
    how: str = "sum",
    prefix: str = "cum_",
) -> DataFrame:
    """Add inclusive running ``sum`` or ``min`` of ``value_cols`` in ``order_cols`` order.

    ``order_cols`` must give a total order.  Same positions as ``global_ranks``;
    within each range partition the running value is a window partitioned by
    that partition (bounded by the range partition size), and the carry-in from
    earlier partitions comes from the small table of per-partition totals.
    """
    agg = {"sum": F.sum, "min": F.min}[how]
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    ordered = ordered.checkpoint(eager=True)
    pos = ordered.withColumn("_pid", F.shiftright("_mid", _POS_BITS))
    totals = pos.groupBy("_pid").agg(*[agg(c).alias(f"_tot_{c}") for c in value_cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[agg(f"_tot_{c}").over(before).alias(f"_off_{c}") for c in value_cols])
    within = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = pos.join(F.broadcast(offsets), "_pid")
    for c in value_cols:
        run = agg(c).over(within)
        carry = F.col(f"_off_{c}")
        value = F.coalesce(carry, F.lit(0)) + run if how == "sum" else F.least(carry, run)
        out = out.withColumn(f"{prefix}{c}", value)
    return out.drop("_mid", "_pid", *[f"_off_{c}" for c in value_cols])


def global_running_sums(
    df: DataFrame, order_cols: list[str | Column], value_cols: list[str], prefix: str = "cum_"
) -> DataFrame:
    """Inclusive running sums (see ``global_running``)."""
    return global_running(df, order_cols, value_cols, "sum", prefix)


def cut_positions(n: int, k: int) -> dict[str, tuple[float, int]]:
    """Per rule and cut j: (j / k, position of the last row before the cut among ``n``)."""
    base, extra = divmod(n, k)
    out = {}
    for j in range(1, k):
        out[f"ntile{j}"] = (j / k, j * base + min(j, extra))
        out[f"qcut{j}"] = (j / k, (j * (n - 1) + k - 1) // k if n else 0)
    return out


def tile_cuts(df: DataFrame, order_cols: list[Column], k: int = 3) -> dict[str, tuple]:
    """The rows at the cuts of both rules: three small jobs over ``df``."""
    return rows_at(df, order_cols, lambda n: cut_positions(n, k))[1]


def tile_of(order_cols: list[Column], cuts: dict[str, tuple], k: int = 3, method: str = "ntile") -> Column:
    """Tile (1..k) of a row by comparison with the cuts."""
    if method not in ("ntile", "qcut"):
        raise ValueError(f"unknown tiling method {method!r}")
    tile = F.lit(1)
    for j in range(1, k):
        tile = tile + after(order_cols, cuts.get(f"{method}{j}")).cast("int")
    return tile


def add_tiles(
    df: DataFrame, order_cols: list[str | Column], k: int = 3, method: str = "ntile", tile_col: str = "tile"
) -> DataFrame:
    """Exact tiles over the whole DataFrame; ``order_cols`` must end with a unique key."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    return df.withColumn(tile_col, tile_of(cols, tile_cuts(df, cols, k), k, method))
