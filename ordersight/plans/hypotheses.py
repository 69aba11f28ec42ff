"""Formal hypothesis tests (Q23 - Q32).

Every test is: population filter -> distributed counts -> one global aggregate
producing the statistic.  Each ``*_stats`` function returns a one-row frame
with unrounded statistics; ``test_*`` rounds them as the published summary
does.  The summary with p-values lives in ``plans.summary``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions.columns import (
    ALPHA,
    SHORT_REVIEW_GROUPS,
    delay_bucket_ordinal,
    review_group_cut,
    round_half_up,
)
from ordersight.functions.tails import chi2_tail
from ordersight.operators.contingency import (
    chi2_2x2_expr,
    chi2_two_column,
    mantel_haenszel,
    mh_aggregates,
    mh_pooled_odds_ratio,
    mh_statistic,
    odds_ratio_expr,
    two_column_counts,
)
from ordersight.operators.fdr import benjamini_hochberg
from ordersight.operators.first_orders import first_reviewed_orders
from ordersight.operators.grains import on_time_item_grain, seller_order_grain
from ordersight.operators.mart import delivered_reviewed
from ordersight.operators.ranks import rank_tests
from ordersight.operators.shared import shared
from ordersight.plans.descriptive import elapsed_delay_days
from ordersight.plans.freight import with_freight_tercile
from ordersight.plans.retention import repeaters_elapsed


#: Arrays that the sellers' counts fold into.
SELLER_BUCKETS = 256


def _r(c: str | Column, d: int) -> Column:
    return round_half_up(F.col(c) if isinstance(c, str) else c, d)


# ---------------------------------------------------------------------------
# Populations
# ---------------------------------------------------------------------------
#: Grouping sets of the shared counts: what each test's table is counted by.
_DIMENSIONS = ("bucket", "state", "tercile", "multi", "late", "low")
_SETS = {
    "delay": ("bucket", "low"),
    "state": ("state", "late", "low"),
    "freight": ("tercile", "low"),
    "complexity": ("multi", "late", "low"),
}


def order_test_counts(mart: DataFrame) -> DataFrame:
    """Counts of all tests at the order grain (H1, H5, H5b, H6, H8), from one pass over the fact table.

    One aggregate by grouping sets; ``gid`` tells the sets apart.  A dimension is NULL
    for orders outside its test's population.
    """

    def build() -> DataFrame:
        dated = F.col("delivery_delay_days").isNotNull() & F.col("is_late_delivery").isNotNull()
        facts = with_freight_tercile(delivered_reviewed(mart), mart, "qcut").select(
            F.when(dated, delay_bucket_ordinal(elapsed_delay_days())).alias("bucket"),
            F.when(dated, F.col("customer_state")).alias("state"),
            F.col("freight_ratio_tercile").alias("tercile"),
            (F.col("item_count") > 1).cast("int").alias("multi"),
            F.col("is_late_delivery").alias("late"),
            F.col("is_low_review").alias("low"),
        )
        sets = [[F.col(c) for c in s] for s in _SETS.values()]
        counts = facts.groupingSets(sets, *[F.col(c) for c in _DIMENSIONS])
        return counts.agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))

    return shared(mart, "order_test_counts", build)


def _counts_of(mart: DataFrame, name: str, *known: str) -> DataFrame:
    """The rows of one grouping set whose ``known`` dimensions are present."""
    gid = sum(1 << i for i, c in enumerate(reversed(_DIMENSIONS)) if c not in _SETS[name])
    rows = order_test_counts(mart).where(F.col("gid") == gid)
    for c in known:
        rows = rows.where(F.col(c).isNotNull())
    return rows


def _n_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _by_low(rows: DataFrame, dimension: str) -> DataFrame:
    low = F.col("low")
    return rows.groupBy(F.col(dimension).alias("row")).agg(_n_if(low == 0).alias("o0"), _n_if(low == 1).alias("o1"))


def h5_counts(mart: DataFrame, min_orders: int) -> DataFrame:
    """State x low-review counts of the states with at least ``min_orders`` orders."""
    return _by_low(_counts_of(mart, "state", "state"), "state").where(F.col("o0") + F.col("o1") >= min_orders)


def h9_counts(raw: dict[str, DataFrame], min_items: int) -> DataFrame:
    """On-time items: category x low-review item counts (o0 = not low, o1 = low),
    categories with at least ``min_items`` items."""

    def build() -> DataFrame:
        g = on_time_item_grain(raw)
        low = F.col("is_low_review") == 1
        return g.groupBy(F.col("category").alias("row")).agg(
            F.sum(F.when(~low, F.col("n_items")).otherwise(F.lit(0))).alias("o0"),
            F.sum(F.when(low, F.col("n_items")).otherwise(F.lit(0))).alias("o1"),
        )

    counts = shared(raw, "on_time_category_counts", build)
    return counts.where(F.col("o0") + F.col("o1") >= min_items)


def h12_orders(raw: dict[str, DataFrame], min_orders: int, min_on_time: int) -> DataFrame:
    """One row per on-time order of an eligible seller, attributed to one seller.

    Eligible: >= ``min_orders`` delivered orders and >= ``min_on_time`` on-time
    orders.  An order with several eligible sellers is attributed to the seller
    of its smallest (order_item_id, seller_id) item (D12).
    """
    so = seller_order_grain(raw)
    eligible = (
        so.groupBy("seller_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_late") == 0).alias("n_ot"))
        .where((F.col("n") >= min_orders) & (F.col("n_ot") >= min_on_time))
        .select("seller_id")
    )
    cand = so.where(F.col("is_late") == 0).join(eligible, "seller_id", "left_semi")
    first = cand.groupBy("order_id").agg(F.min(F.struct("first_item_id", "seller_id", "mean_score")).alias("_k"))
    return first.select(
        "order_id",
        F.col("_k.seller_id").alias("seller_id"),
        (F.col("_k.mean_score") <= 2).cast("int").alias("is_low"),
    )


def h10_first_orders(mart: DataFrame, cutoff: str) -> DataFrame:
    return first_reviewed_orders(mart, cutoff).select(
        review_group_cut("review_score", SHORT_REVIEW_GROUPS).alias("review_group"), "has_repeat"
    )


# ---------------------------------------------------------------------------
# Unrounded statistics
# ---------------------------------------------------------------------------
def h1_stats(mart: DataFrame) -> DataFrame:
    """Delay bucket (ordinal 0..3, elapsed days) vs low review: chi2, dof, V, Cochran-Armitage z."""
    return chi2_two_column(_by_low(_counts_of(mart, "delay", "bucket"), "bucket"), score="row")


def h5_stats(mart: DataFrame, min_orders: int) -> DataFrame:
    return chi2_two_column(h5_counts(mart, min_orders))


def h5b_strata(mart: DataFrame, min_orders: int) -> DataFrame:
    """Per state 2 x 2: rows late 0/1, columns low 0/1 -> a=(0,0) b=(0,1) c=(1,0) d=(1,1)."""
    late, low = F.col("late"), F.col("low")
    return (
        _counts_of(mart, "state", "state")
        .groupBy(F.col("state").alias("customer_state"))
        .agg(
            F.sum("n").alias("n"),
            _n_if((late == 0) & (low == 0)).alias("a"),
            _n_if((late == 0) & (low == 1)).alias("b"),
            _n_if((late == 1) & (low == 0)).alias("c"),
            _n_if((late == 1) & (low == 1)).alias("d"),
        )
        .where(F.col("n") >= min_orders)
    )


def h5b_stats(mart: DataFrame, min_orders: int, min_stratum_n: int) -> DataFrame:
    return mantel_haenszel(h5b_strata(mart, min_orders), min_stratum_n)


def h6_stats(mart: DataFrame) -> DataFrame:
    """qcut freight-ratio tercile (scores 1..3) vs low review."""
    return chi2_two_column(_by_low(_counts_of(mart, "freight", "tercile"), "tercile"), score="row")


def h8_stats(mart: DataFrame) -> DataFrame:
    """Multi-item vs low review: Yates chi2 and OR of the whole table, MH across lateness.

    Three strata (lateness 0, 1 and unknown) feed a single aggregate: whole-table
    cells sum over all strata, the MH sums skip the unknown one.
    """
    multi, low = F.col("multi"), F.col("low")
    strata = (
        _counts_of(mart, "complexity", "multi")
        .groupBy(F.col("late").alias("is_late_delivery"))
        .agg(
            _n_if((multi == 0) & (low == 0)).cast("double").alias("a"),
            _n_if((multi == 0) & (low == 1)).cast("double").alias("b"),
            _n_if((multi == 1) & (low == 0)).cast("double").alias("c"),
            _n_if((multi == 1) & (low == 1)).cast("double").alias("d"),
        )
    )
    agg = strata.agg(
        *[F.sum(x).alias(f"t_{x}") for x in "abcd"],
        *mh_aggregates(F.col("is_late_delivery").isNotNull()),
    )
    # Odds ratio with rows [multi=1, multi=0] x columns [low=1, low=0].
    return agg.select(
        (F.col("t_a") + F.col("t_b") + F.col("t_c") + F.col("t_d")).cast("long").alias("n"),
        F.lit(1).alias("dof"),
        chi2_2x2_expr("t_a", "t_b", "t_c", "t_d", yates=True).alias("chi2"),
        odds_ratio_expr("t_d", "t_c", "t_b", "t_a").alias("odds_ratio"),
        mh_statistic().alias("mh_statistic"),
        mh_pooled_odds_ratio().alias("mh_pooled_odds_ratio"),
    )


def h9_stats(raw: dict[str, DataFrame], min_items: int) -> DataFrame:
    counts = h9_counts(raw, min_items)
    overall = (F.lit(100.0) * F.sum("o1") / F.sum(F.col("o0") + F.col("o1"))).alias("overall_low_review_rate_pct")
    return chi2_two_column(counts, extra=(overall,))


def h12_stats(raw: dict[str, DataFrame], min_orders: int, min_on_time: int) -> DataFrame:
    """Sellers grow with the data, so their counts fold in many arrays."""
    counts = two_column_counts(h12_orders(raw, min_orders, min_on_time), "seller_id", "is_low")
    return chi2_two_column(counts, buckets=SELLER_BUCKETS)


def h10_stats(mart: DataFrame, cutoff: str) -> DataFrame:
    counts = two_column_counts(h10_first_orders(mart, cutoff), "review_group", "has_repeat")
    rates = [
        F.max(F.when(F.col("row") == g, F.col("o1") / (F.col("o0") + F.col("o1")))).alias(f"rate_{g.lower()}")
        for g in SHORT_REVIEW_GROUPS
    ]
    return chi2_two_column(counts, extra=tuple(rates)).withColumn(
        "delta_pp", F.lit(100.0) * (F.col("rate_high") - F.col("rate_low"))
    )


def h11_stats(mart: DataFrame, cutoff: str) -> DataFrame:
    return rank_tests(repeaters_elapsed(mart, cutoff), "days_to_next", "review_group", "Low", "High")


# ---------------------------------------------------------------------------
# Rounded per-test tables (oracle-checked)
# ---------------------------------------------------------------------------
def test_h1_delay(mart: DataFrame) -> DataFrame:
    """Q23: chi-square + Cochran-Armitage trend (scores 0..3) + Cramér's V."""
    s = h1_stats(mart)
    return s.select("n", "dof", _r("chi2", 3).alias("chi2"), _r("trend_z", 3).alias("trend_z"), _r("cramers_v", 4).alias("cramers_v"))


def test_h5_state(mart: DataFrame, min_orders: int = 200) -> DataFrame:
    """Q24: customer state vs low review among states with enough orders."""
    s = h5_stats(mart, min_orders)
    return s.select("n", "dof", _r("chi2", 3).alias("chi2"), _r("cramers_v", 4).alias("cramers_v"))


def test_h5b_late_by_state(mart: DataFrame, min_orders: int = 200, min_stratum_n: int = 20) -> DataFrame:
    """Q25: Mantel-Haenszel, late vs low review stratified by state."""
    s = h5b_stats(mart, min_orders, min_stratum_n)
    return s.select(
        "strata", _r("mh_statistic", 3).alias("mh_statistic"), _r("pooled_odds_ratio", 3).alias("pooled_odds_ratio")
    )


def test_h6_freight(mart: DataFrame) -> DataFrame:
    """Q26: freight-ratio tercile (qcut) vs low review - chi-square, trend (scores 1..3), V."""
    s = h6_stats(mart)
    return s.select("n", "dof", _r("chi2", 3).alias("chi2"), _r("trend_z", 3).alias("trend_z"), _r("cramers_v", 4).alias("cramers_v"))


def test_h8_complexity(mart: DataFrame) -> DataFrame:
    """Q27: multi-item vs low review - Yates chi-square, odds ratio, MH across lateness."""
    s = h8_stats(mart)
    return s.select(
        "n",
        "dof",
        _r("chi2", 3).alias("chi2"),
        _r("odds_ratio", 3).alias("odds_ratio"),
        _r("mh_statistic", 3).alias("mh_statistic"),
    )


def test_h9_category(raw: dict[str, DataFrame], min_items: int = 100) -> DataFrame:
    """Q28: category vs low review among on-time items (item grain)."""
    s = h9_stats(raw, min_items)
    return s.select(
        "n",
        "dof",
        _r("chi2", 3).alias("chi2"),
        _r("cramers_v", 4).alias("cramers_v"),
        _r("overall_low_review_rate_pct", 2).alias("overall_low_review_rate_pct"),
    )


def category_vs_rest(raw: dict[str, DataFrame], min_items: int = 100) -> DataFrame:
    """Q29: per category 2 x 2 (category vs all other tested categories), Yates chi-square.

    The categories, bounded by their table, fold into one array with its totals and unfold again.
    """
    one = h9_counts(raw, min_items).agg(
        F.collect_list(F.struct("row", "o0", "o1")).alias("cells"), F.sum("o1").alias("low"), F.sum("o0").alias("not_low")
    )
    t = one.select(F.explode("cells").alias("x"), "low", "not_low").select(
        F.col("x.row").alias("category"),
        F.col("x.o1").alias("a"),
        F.col("x.o0").alias("b"),
        (F.col("low") - F.col("x.o1")).alias("c"),
        (F.col("not_low") - F.col("x.o0")).alias("d"),
    )
    return t.withColumn("_chi2", chi2_2x2_expr(yates=True))


def test_category_vs_rest(raw: dict[str, DataFrame], min_items: int = 100) -> DataFrame:
    return category_vs_rest(raw, min_items).select("category", "a", "b", "c", "d", _r("_chi2", 3).alias("chi2"))


def category_vs_rest_fdr(raw: dict[str, DataFrame], min_items: int = 100, alpha: float = ALPHA) -> DataFrame:
    """Q29 with p-values and the Benjamini-Hochberg adjustment."""
    t = category_vs_rest(raw, min_items).withColumn("p_value", chi2_tail("_chi2", "1"))
    out = benjamini_hochberg(t, "p_value", "category", alpha, bounded=True)
    return out.select("category", "a", "b", "c", "d", _r("_chi2", 3).alias("chi2"), "p_value", "p_adjusted", "reject")


def test_h12_seller(raw: dict[str, DataFrame], min_orders: int = 50, min_on_time: int = 30) -> DataFrame:
    """Q30: seller vs low review among on-time orders of eligible sellers."""
    s = h12_stats(raw, min_orders, min_on_time)
    return s.select("n", "dof", _r("chi2", 3).alias("chi2"), _r("cramers_v", 4).alias("cramers_v"))


def test_h10_repeat(mart: DataFrame, cutoff: str) -> DataFrame:
    """Q31: first-review group (cut) vs repeat purchase; effect in percentage points."""
    s = h10_stats(mart, cutoff)
    return s.select(
        "n", "dof", _r("chi2", 3).alias("chi2"), _r("cramers_v", 4).alias("cramers_v"), _r("delta_pp", 3).alias("delta_pp")
    )


def test_h11_days(mart: DataFrame, cutoff: str) -> DataFrame:
    """Q32: Kruskal-Wallis over groups, Mann-Whitney U (Low vs High), Cliff's delta."""
    s = h11_stats(mart, cutoff)
    return s.select(
        "n", "groups", _r("kw_h", 3).alias("kw_h"), _r("mw_u", 3).alias("mw_u"), _r("cliffs_delta", 4).alias("cliffs_delta")
    )
