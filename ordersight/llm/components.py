"""Connected components of an edge table, by alternating large and small stars.

Every round is a pre-aggregated minimum per node and a join back, both on the
edge table alone; nothing is collected but whether any star is left to merge: once every
node either points to one centre or is a centre, no round changes anything.
Rounds are cut from the lineage by ``checkpoint()``, so a lost executor costs one
round.  The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_minimum(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m) with m the smallest neighbour of u."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return edges.join(least, edges["u"] == least["w"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    star = _with_minimum(both).select("u", "v", F.least("u", "m").alias("m"))
    return star.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each smaller neighbour of a node, and the node itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _with_minimum(down)
    moved = star.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = star.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the distinct edges (u, v) are stars: no u has two v, and none is itself a v."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"))
    )
    sides = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return sides.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct().checkpoint()
    for _ in range(max_rounds):
        e = _small_star(_large_star(e)).checkpoint()
        if _settled(e):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
