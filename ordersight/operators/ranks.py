"""Rank statistics from value histograms (X2; T8 - T10).

Kruskal-Wallis and Mann-Whitney need mid-ranks with ties.  Instead of sorting
all observations, the data is reduced to a histogram ``(value, group) -> count``
(partial aggregation before the shuffle).  Mid-ranks then come from a running
sum over the *distinct values*: ``rank(v) = below(v) + (t_v + 1) / 2``.  The
running sum is itself distributed (range-sorted positions plus per-partition
offsets, see ``tiles.global_running_sums``), so even a value table as large as
the data never lands in one task.

Medians per group come from the same histogram: the running count over (group, value)
tells which values hold a group's two middle ranks.

Cliff's delta follows from U without any pairwise work: delta = 2U/(n1 n2) - 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.operators.tiles import global_running_sums


def value_histogram(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(value, group).agg(F.count(F.lit(1)).alias("cnt"))


def group_medians(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, median, n): exact median of the non-NULL values of every group (NULL groups count as one).

    Weighted selection on running counts: no group is gathered, however many values it has.
    """
    hist = value_histogram(df, value, group)
    run = global_running_sums(hist, [F.col(group), F.col(value)], ["cnt"])
    # the counts start anew where a group begins
    spans = run.groupBy(F.col(group).alias("_g")).agg(F.sum("cnt").alias("n"), F.min(F.col("cum_cnt") - F.col("cnt")).alias("_before"))
    j = run.join(spans, F.col(group).eqNullSafe(F.col("_g")))
    to, n = F.col("cum_cnt") - F.col("_before"), F.col("n")
    low, high = F.floor((n + 1) / F.lit(2)), F.floor((n + 2) / F.lit(2))  # the middle ranks
    first = to - F.col("cnt") + 1
    middle = [(first <= r) & (r <= to) for r in (low, high)]
    x = F.col(value).cast("double")
    return (
        j.where(middle[0] | middle[1])
        .groupBy(group, "n")
        .agg(((F.max(F.when(middle[0], x)) + F.max(F.when(middle[1], x))) / F.lit(2.0)).alias("median"))
        .select(group, "median", "n")
    )


def rank_tests(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """Kruskal-Wallis over all groups and Mann-Whitney (first vs second) in one plan.

    Both mid-rank sets (all groups; the two compared groups only) come from the
    same per-value table and the same window ordering.
    """
    hist = value_histogram(df, value, group)
    in_two = F.col(group).isin(first, second)
    per_value = hist.groupBy(value).agg(
        F.sum("cnt").alias("t"), F.sum(F.when(in_two, F.col("cnt")).otherwise(F.lit(0))).alias("t2")
    )
    run = global_running_sums(per_value, [F.col(value)], ["t", "t2"])
    mr = run.select(
        value,
        "t",
        "t2",
        (F.col("cum_t") - F.col("t") + (F.col("t") + 1) / F.lit(2.0)).alias("mid"),
        (F.col("cum_t2") - F.col("t2") + (F.col("t2") + 1) / F.lit(2.0)).alias("mid2"),
    )
    cnt = F.col("cnt").cast("double")
    per_group = (
        hist.join(mr, value)
        .groupBy(group)
        .agg(
            F.sum("cnt").alias("n_g"),
            F.sum(cnt * F.col("mid")).alias("rs"),
            F.sum(cnt * F.col("mid2")).alias("rs2"),
            F.sum(cnt * (F.col("t").cast("double") * F.col("t") - 1)).alias("tie"),
            F.sum(F.when(in_two, cnt * (F.col("t2").cast("double") * F.col("t2") - 1))).alias("tie2"),
        )
    )
    g = per_group.agg(
        F.collect_list(F.struct("n_g", "rs")).alias("by_group"),  # one entry per group label
        F.count(F.lit(1)).alias("k"),
        F.coalesce(F.sum("n_g"), F.lit(0)).cast("double").alias("N"),
        F.sum("tie").alias("tie_sum"),
        F.max(F.when(F.col(group) == first, F.col("rs2"))).alias("r1"),
        F.max(F.when(F.col(group) == first, F.col("n_g"))).cast("double").alias("n1"),
        F.max(F.when(F.col(group) == second, F.col("n_g"))).cast("double").alias("n2"),
        F.sum("tie2").alias("mw_tie_sum"),
    )
    n, n1, n2 = F.col("N"), F.col("n1"), F.col("n2")
    # spread of the groups' mean ranks around the overall mean rank: no difference of large sums
    between = F.aggregate(
        "by_group",
        F.lit(0.0),
        lambda acc, x: acc + x["n_g"] * F.pow(F.try_divide(x["rs"], x["n_g"]) - (n + 1) / F.lit(2.0), F.lit(2.0)),
    )
    untied = F.lit(1.0) - F.try_divide(F.col("tie_sum"), n * n * n - n)
    # NULL where the statistic is undefined: no rows, a single row, all values tied
    h = F.try_divide(F.try_divide(F.lit(12.0) * between, n * (n + 1)), F.when(untied > 0, untied))
    u1 = F.col("r1") - n1 * (n1 + 1) / F.lit(2.0)
    return g.select(
        n.cast("long").alias("n"),
        F.col("k").cast("int").alias("groups"),
        h.alias("kw_h"),
        u1.alias("mw_u"),
        n1.cast("long").alias("n1"),
        n2.cast("long").alias("n2"),
        F.col("mw_tie_sum"),
        (F.try_divide(F.lit(2.0) * u1, n1 * n2) - F.lit(1.0)).alias("cliffs_delta"),
    )
