"""Summary of all hypothesis tests with p-values and verdicts (Q33).

One row per test, built from the one-row statistic frames; p-values come from
native tail probabilities.  Column layout and rounding follow the published
summary; ``trend_z`` is overloaded there (trend z for H1 and H6/H7, the MH
statistic for H8, the number of FDR-significant categories for H9, U for H11)
and is kept that way for parity - the per-test tables use proper names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions.columns import ALPHA, round_half_up
from ordersight.functions.tails import p_value_of
from ordersight.operators.contingency import chi2_two_column
from ordersight.plans import hypotheses as h

# ---------------------------------------------------------------------------
# Hypothesis ids, questions, test names, effect labels and notes
# of the summary table, in the order the tests are reported.
# ---------------------------------------------------------------------------
H1 = ("H1", "Delay bucket vs low review", "Chi-square + Cochran-Armitage trend", "Cramer's V",
      "Strong monotonic deterioration with lateness")
H5 = ("H5", "Customer state vs low review", "Chi-square independence", "Cramer's V",
      "Regional differences exist; effect size is small vs delay")
H5B = ("H5b", "Late vs low review within states (MH)", "Mantel-Haenszel", "Common OR (late)",
       "Delay effect persists after stratifying by state")
H6 = ("H6/H7", "Freight-ratio tercile vs low review", "Chi-square + Cochran-Armitage", "Cramer's V",
      "Statistically detectable but much smaller than delay effect")
H8 = ("H8", "Multi-item vs low review (MH by late)", "Chi-square + Mantel-Haenszel", "OR (multi-item)",
      "Complexity associated with low reviews even after late strata")
H9 = ("H9", "Category vs low review (on-time only)", "Chi-square (+ BH-FDR pairwise vs rest)", "Cramer's V",
      "On-time-only control for logistics; %d categories differ from rest after FDR "
      "(overall on-time low-review %.2f%%)")
H12 = ("H12", "Seller vs low review (on-time orders)", "Chi-square", "Cramer's V",
       "Seller heterogeneity remains after restricting to on-time")
H10 = ("H10", "First-review group vs repeat purchase", "Chi-square", "Delta pp (High - Low)",
       "Effect is small in magnitude (High %.2f%% vs Low %.2f%%); treat as supplementary signal")
H11 = ("H11", "Days to repurchase by first-review group", "Kruskal-Wallis (+ Mann-Whitney Low vs High)",
       "Cliff's delta (Low vs High)",
       "Among repeaters only; interpret cautiously — small practical retention signal relative to delivery delay")

SUMMARY_COLUMNS = [
    "hypothesis",
    "question",
    "test",
    "statistic",
    "p_value",
    "trend_z",
    "trend_p_value",
    "effect_size",
    "effect_label",
    "significant_0_05",
    "note",
]



def _row(
    stats: DataFrame,
    ids: tuple,
    statistic: Column,
    p_test: tuple,
    trend_z: Column,
    trend_test: tuple,
    effect: Column,
    note: Column,
    both_p: bool = False,
) -> DataFrame:
    """One summary row with the arguments of its p-values (computed later, together).

    ``p_test`` / ``trend_test`` are ``(kind, a, b, c, d)`` as understood by
    ``functions.tails.p_value_of``; kind ``None`` means no p-value.
    """

    def args(prefix: str, test: tuple) -> list[Column]:
        kind, *vals = test
        vals = list(vals) + [None] * (4 - len(vals))
        cols = [F.lit(kind).cast("string").alias(f"{prefix}_kind")]
        for name, v in zip("abcd", vals):
            col = v if isinstance(v, Column) else (F.col(v) if isinstance(v, str) else F.lit(v))
            cols.append(col.cast("double").alias(f"{prefix}_{name}"))
        return cols

    hyp, question, test, label = ids[0], ids[1], ids[2], ids[3]
    return stats.select(
        F.lit(hyp).alias("hypothesis"),
        F.lit(question).alias("question"),
        F.lit(test).alias("test"),
        statistic.cast("double").alias("statistic"),
        trend_z.cast("double").alias("trend_z"),
        effect.cast("double").alias("effect_size"),
        F.lit(label).alias("effect_label"),
        note.alias("note"),
        F.lit(both_p).alias("_both"),
        *args("_p", p_test),
        *args("_t", trend_test),
    )


def hypothesis_summary(
    mart: DataFrame,
    raw: dict[str, DataFrame],
    cutoff: str,
    min_state_orders: int = 200,
    min_stratum_n: int = 20,
    min_category_items: int = 100,
    min_seller_orders: int = 50,
    min_seller_on_time: int = 30,
    alpha: float = ALPHA,
) -> DataFrame:
    """All tests in one table; the nine rows are assembled first and the
    p-values are then computed in a single projection."""
    r = round_half_up
    null = F.lit(None).cast("double")
    none = (None,)
    rows = []

    s = h.h1_stats(mart)
    rows.append(_row(s, H1, r(F.col("chi2"), 3), ("chi2", "chi2", "dof"), r(F.col("trend_z"), 3),
                     ("trend", "trend_z"), r(F.col("cramers_v"), 4), F.lit(H1[4]), both_p=True))
    s = h.h5_stats(mart, min_state_orders)
    rows.append(_row(s, H5, r(F.col("chi2"), 3), ("chi2", "chi2", "dof"), null, none, r(F.col("cramers_v"), 4),
                     F.lit(H5[4])))
    s = h.h5b_stats(mart, min_state_orders, min_stratum_n)
    rows.append(_row(s, H5B, r(F.col("mh_statistic"), 3), ("chi2", "mh_statistic", 1.0), null, none,
                     r(F.col("pooled_odds_ratio"), 3), F.lit(H5B[4])))
    s = h.h6_stats(mart)
    rows.append(_row(s, H6, r(F.col("chi2"), 3), ("chi2", "chi2", "dof"), r(F.col("trend_z"), 3),
                     ("trend", "trend_z"), r(F.col("cramers_v"), 4), F.lit(H6[4])))
    s = h.h8_stats(mart)
    rows.append(_row(s, H8, r(F.col("chi2"), 3), ("chi2", "chi2", "dof"), r(F.col("mh_statistic"), 3),
                     ("chi2", "mh_statistic", 1.0), r(F.col("odds_ratio"), 3), F.lit(H8[4]), both_p=True))
    # H9: the omnibus test and the FDR count come from the same per-category table.
    t9 = h.category_vs_rest_fdr(raw, min_category_items, alpha).select(
        F.col("category").alias("row"), F.col("b").alias("o0"), F.col("a").alias("o1"), "reject"
    )
    s9 = chi2_two_column(
        t9,
        extra=(
            F.count_if(F.col("reject")).alias("n_sig"),
            (F.lit(100.0) * F.sum("o1") / F.sum(F.col("o0") + F.col("o1"))).alias("overall_pct"),
        ),
    )
    rows.append(_row(s9, H9, r(F.col("chi2"), 3), ("chi2", "chi2", "dof"), F.col("n_sig"), none,
                     r(F.col("cramers_v"), 4), F.format_string(H9[4], F.col("n_sig"), F.col("overall_pct"))))
    s = h.h12_stats(raw, min_seller_orders, min_seller_on_time)
    rows.append(_row(s, H12, r(F.col("chi2"), 3), ("chi2", "chi2", "dof"), null, none, r(F.col("cramers_v"), 4),
                     F.lit(H12[4])))
    s = h.h10_stats(mart, cutoff)
    rows.append(_row(s, H10, r(F.col("chi2"), 3), ("chi2", "chi2", "dof"), null, none, r(F.col("delta_pp"), 3),
                     F.format_string(H10[4], F.col("rate_high") * 100, F.col("rate_low") * 100)))
    s = h.h11_stats(mart, cutoff)
    rows.append(_row(s, H11, r(F.col("kw_h"), 3), ("chi2", "kw_h", F.col("groups") - 1), r(F.col("mw_u"), 3),
                     ("mw", "mw_u", "n1", "n2", "mw_tie_sum"), r(F.col("cliffs_delta"), 4), F.lit(H11[4])))

    u = reduce(DataFrame.unionByName, rows).coalesce(1)
    with_p = u.withColumn("p_value", p_value_of(*[f"_p_{x}" for x in ("kind", *"abcd")])).withColumn(
        "trend_p_value", p_value_of(*[f"_t_{x}" for x in ("kind", *"abcd")])
    )
    sig = F.col("p_value") < alpha
    sig = F.when(F.col("_both"), sig & (F.col("trend_p_value") < alpha)).otherwise(sig)
    return with_p.withColumn("significant_0_05", sig).select(*SUMMARY_COLUMNS)
