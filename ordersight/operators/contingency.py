"""Contingency-table statistics as DataFrame aggregations.

Counting runs distributed over the data; each statistic is then one global
aggregate over the small long table of counts, so no contingency table is ever
collected to the driver and no table of totals has to be joined back.

Pearson chi-square of an r x 2 table (rows i, outcome columns 0/1) is the sum of
centred terms

    chi2 = sum_i (o1_i - R_i p)^2 / (R_i p (1 - p)),   p = C1 / N

The counts are evaluated once: they fold into an array together with their totals, and
the centred terms are summed over the array, so that large counts do not cancel.
Where the levels are not bounded (sellers) the counts fold in ``buckets`` arrays, each
centred on its own share, and the arrays' sums are moved to the common share:
sum_b [dev_b + N_b (p_b - p)^2].  For a 2 x 2 table the Yates continuity correction is
applied as the library default does when dof = 1 (each |O - E| is reduced by
min(0.5, |O - E|)); Cramér's V always uses the uncorrected statistic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions.tails import normal_two_sided


def two_column_counts(df: DataFrame, row: str | Column, flag: str | Column, row_name: str = "row") -> DataFrame:
    """Long counts: one row per level of ``row`` with outcome counts ``o0`` and ``o1``."""
    f = F.col(flag) if isinstance(flag, str) else flag
    r = F.col(row) if isinstance(row, str) else row
    return (
        df.where(f.isNotNull() & r.isNotNull())
        .groupBy(r.alias(row_name))
        .agg(F.count_if(f == 0).alias("o0"), F.count_if(f == 1).alias("o1"))
    )


def _folded(cells: str, share: Column) -> Column:
    """sum_i (o1_i - R_i share)^2 / R_i over an array of cells."""
    return F.aggregate(
        cells,
        F.lit(0.0),
        lambda acc, x: acc + F.pow(x["o1"] - x["_R"] * share, F.lit(2.0)) / x["_R"],
    )


def chi2_two_column(
    counts: DataFrame,
    row_name: str = "row",
    yates: bool = True,
    score: str | Column | None = None,
    extra: tuple[Column, ...] = (),
    buckets: int = 1,
) -> DataFrame:
    """One-row DataFrame: n, rows, cols, dof, chi2, chi2_uncorrected, cramers_v.

    Levels with no observations are dropped (D19); an outcome column with no
    observations is dropped as well.  With ``score`` the two-sided
    Cochran-Armitage trend z over the levels is added (``o1`` is the outcome of
    interest).  ``extra`` aggregates over the counts table are carried along in
    the same single aggregation.  With one bucket the levels must be few enough for one
    array; more ``buckets`` spread any number of levels (without ``score`` and ``extra``).
    """
    if buckets > 1 and (extra or score is not None):
        raise ValueError("score and extra aggregates need a single bucket")
    t = counts.withColumn("_R", F.col("o0") + F.col("o1")).where(F.col("_R") > 0)
    ends = [
        F.min(F.struct(F.col(row_name).alias("row"), "o0", "o1")).alias("_x"),
        F.max(F.struct(F.col(row_name).alias("row"), "o0", "o1")).alias("_y"),
    ]
    aggs = [
        F.sum("_R").cast("double").alias("n"),
        F.sum("o0").cast("double").alias("c0"),
        F.sum("o1").cast("double").alias("c1"),
        F.count(F.lit(1)).alias("rows"),
        F.sort_array(F.collect_list(F.struct("_R", "o1"))).alias("cells"),
        *ends,
    ]
    if score is not None:
        sc = (F.col(score) if isinstance(score, str) else score).cast("double")
        aggs += [
            F.sum(F.col("o1") * sc).alias("_sxt"),
            F.sum(F.col("_R") * sc).alias("_snt"),
            F.sum(F.col("_R") * sc * sc).alias("_sntt"),
        ]
    if buckets > 1:
        parts = t.groupBy(F.pmod(F.xxhash64(row_name), F.lit(buckets)).alias("_b")).agg(*aggs)
        own = F.try_divide(F.col("c1"), F.col("n"))
        parts = parts.withColumn("dev", _folded("cells", own)).withColumn("share", own).drop("cells")
        agg = parts.agg(
            *[F.sum(c).alias(c) for c in ("n", "c0", "c1")],
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.sort_array(F.collect_list(F.struct("n", "share", "dev"))).alias("parts"),
            F.min("_x").alias("_x"),
            F.max("_y").alias("_y"),
        )
        share = F.try_divide(F.col("c1"), F.col("n"))
        moved = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["dev"] + x["n"] * F.pow(x["share"] - share, F.lit(2.0)))
        agg = agg.withColumn("dev", moved).drop("parts")
    else:
        agg = t.agg(*aggs, *extra)
        agg = agg.withColumn("dev", _folded("cells", F.try_divide(F.col("c1"), F.col("n")))).drop("cells")
    cols = "(cast(c0 > 0 AS INT) + cast(c1 > 0 AS INT))"
    # one empty column says nothing (0); without rows there is no statistic (NULL)
    raw_chi2 = "CASE WHEN c0 > 0 AND c1 > 0 THEN dev * (n / c0) * (n / c1) WHEN n IS NOT NULL THEN 0D END"
    # 2 x 2: |ad - bc| / n is the common |O - E| of all four cells
    delta = "try_divide(abs(cast(_x.o0 AS DOUBLE) * _y.o1 - cast(_x.o1 AS DOUBLE) * _y.o0), n)"
    inverse = "try_divide(n * n * n, cast(_x.o0 + _x.o1 AS DOUBLE) * (_y.o0 + _y.o1) * c0 * c1)"
    names = [c for c in agg.columns if c not in {"n", "c0", "c1", "dev", "rows", "_x", "_y", "_sxt", "_snt", "_sntt"}]
    keep = ["c1", "_sxt", "_snt", "_sntt"] if score is not None else []
    one = agg.selectExpr(
        "n", "rows", f"{cols} AS cols", f"cast((rows - 1) * ({cols} - 1) AS INT) AS dof", f"{raw_chi2} AS chi2_uncorrected",
        f"pow({delta} - least(0.5D, {delta}), 2D) * {inverse} AS _yates", *keep, *[f"`{c}`" for c in names],
    )
    corrected = "WHEN dof = 1 THEN _yates" if yates else ""
    out = [
        "cast(n AS BIGINT) AS n", "rows", "cols", "dof",
        f"CASE WHEN dof <= 0 THEN 0D {corrected} ELSE chi2_uncorrected END AS chi2", "chi2_uncorrected",
        "CASE WHEN least(rows, cols) > 1 THEN sqrt(chi2_uncorrected / (n * (least(rows, cols) - 1))) END AS cramers_v",
    ]
    if score is not None:
        share = "try_divide(c1, n)"
        spread = f"sqrt({share} * (1D - {share}) * (_sntt - try_divide(_snt * _snt, n)))"
        out.append(f"CASE WHEN {spread} > 0 THEN (_sxt - {share} * _snt) / {spread} END AS trend_z")
    return one.selectExpr(*out, *[f"`{c}`" for c in names])


def cochran_armitage(counts: DataFrame, score: str | Column) -> DataFrame:
    """Two-sided Cochran-Armitage trend z and its p-value over per-level counts (``o0``, ``o1``) and scores."""
    return chi2_two_column(counts, score=score).select("trend_z", normal_two_sided("trend_z").alias("p_value"))


def odds_ratio_expr(a="a", b="b", c="c", d="d") -> Column:
    """a*d / (b*c); NULL when b*c = 0."""
    bc = F.col(b).cast("double") * F.col(c)
    return F.when(bc > 0, F.col(a).cast("double") * F.col(d) / bc)


def chi2_2x2_expr(a="a", b="b", c="c", d="d", yates: bool = True) -> Column:
    """Closed-form chi-square of the 2 x 2 table [[a, b], [c, d]] (Yates when asked)."""
    a, b, c, d = (F.col(x).cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    delta = F.abs(a * d - b * c) / n
    dev = delta - F.least(F.lit(0.5), delta) if yates else delta
    return F.when(margins > 0, dev * dev * n * n * n / margins).otherwise(F.lit(0.0))


def mh_aggregates(where: Column | None = None) -> list[Column]:
    """Aggregates over strata rows (a, b, c, d, n as doubles) for the Mantel-Haenszel test."""
    apb, apc = F.col("a") + F.col("b"), F.col("a") + F.col("c")
    bpd, cpd = F.col("b") + F.col("d"), F.col("c") + F.col("d")
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")

    def keep(x: Column) -> Column:
        return x if where is None else F.when(where, x)

    return [
        F.sum(keep(F.col("a") - apb * apc / n)).alias("_mh_dev"),
        F.sum(keep(F.when(n > 1, apb * apc * bpd * cpd / (n * n * (n - 1))))).alias("_mh_var"),
        F.sum(keep(F.col("a") * F.col("d") / n)).alias("_mh_ad"),
        F.sum(keep(F.col("b") * F.col("c") / n)).alias("_mh_bc"),
        F.count(keep(F.lit(1))).alias("strata"),
    ]


def mh_statistic() -> Column:
    return F.when(F.col("_mh_var") > 0, F.col("_mh_dev") * F.col("_mh_dev") / F.col("_mh_var"))


def mh_pooled_odds_ratio() -> Column:
    return F.when(F.col("_mh_bc") > 0, F.col("_mh_ad") / F.col("_mh_bc"))


def mantel_haenszel(strata: DataFrame, min_stratum_n: int | None = None) -> DataFrame:
    """Mantel-Haenszel test of a common odds ratio of 1, and the pooled odds ratio.

    ``strata`` has one row per stratum with cells a, b (first row) and c, d
    (second row).  Statistic (sum a - sum E[a])^2 / sum Var[a] without
    continuity correction; pooled OR = sum(ad/n) / sum(bc/n).
    With ``min_stratum_n``, a stratum is kept when all four cells are positive
    or it has at least that many observations (D9).
    """
    s = strata.select(*[F.col(k).cast("double").alias(k) for k in "abcd"])
    if min_stratum_n is not None:
        n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
        all_pos = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0)
        s = s.where(all_pos | (n >= min_stratum_n))
    return s.agg(*mh_aggregates()).select(
        mh_statistic().alias("mh_statistic"), mh_pooled_odds_ratio().alias("pooled_odds_ratio"), "strata"
    )
