"""Statistics: published tables -> published statistics, fixtures, properties."""

from __future__ import annotations

from fractions import Fraction
import itertools
import math
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordersight.functions.tails import chi2_sf, mann_whitney_p, two_sided_from_cdf
from ordersight.operators.contingency import chi2_2x2_expr, chi2_two_column, mantel_haenszel
from ordersight.operators.fdr import benjamini_hochberg
from ordersight.operators.ranks import rank_tests
from ordersight.operators.tiles import add_tiles


def counts_df(spark, rows):
    return spark.createDataFrame(rows, "row string, o0 long, o1 long")


# --- golden statistics recomputed from published tables ------------
def test_h10_published_table(spark):
    # First-review group, customers, customers with a next order.
    t = [("Low", 10725 - 317, 317), ("Neutral", 6854 - 216, 216), ("High", 63127 - 2124, 2124)]
    r = chi2_two_column(counts_df(spark, t)).collect()[0]
    assert r.dof == 2 and r.n == 80706
    assert round(r.chi2, 3) == 5.281
    assert abs(chi2_sf(r.chi2, r.dof) - 0.0713172) < 1e-6


def test_h8_published_yates_and_odds_ratio(spark):
    # Fixed values: [[single not low, single low], [multi not low, multi low]].
    r = chi2_two_column(counts_df(spark, [("single", 76609, 9695), ("multi", 6986, 2542)])).collect()[0]
    assert r.dof == 1 and round(r.chi2, 3) == 1836.438
    cells = spark.createDataFrame([(2542, 6986, 9695, 76609)], "a long, b long, c long, d long")
    assert round(cells.select((F.col("a") * F.col("d") / (F.col("b") * F.col("c"))).alias("x")).first().x, 3) == 2.875
    assert round(cells.select(chi2_2x2_expr().alias("x")).first().x, 3) == 1836.438


def test_h8_published_mantel_haenszel(spark):
    # Per lateness stratum a=(single, not low) b=(single, low) c=(multi, not low) d=(multi, low).
    strata = spark.createDataFrame(
        [(7052 - 3782, 3782, 609 - 354, 354), (79244 - 5912, 5912, 8919 - 2188, 2188)],
        "a long, b long, c long, d long",
    )
    r = mantel_haenszel(strata).collect()[0]
    assert round(r.mh_statistic, 3) == 2403.789


def test_h6_published_terciles(spark):
    t = [("1", 31944 - 3915, 3915), ("2", 31944 - 4031, 4031), ("3", 31944 - 4291, 4291)]
    r = chi2_two_column(counts_df(spark, t), score=F.col("row").cast("int")).collect()[0]
    assert round(r.chi2, 3) == 20.838 and round(r.trend_z, 3) == 4.457 and round(r.cramers_v, 4) == 0.0147
    assert abs(chi2_sf(r.chi2, 2) - 2.986221520250e-05) < 1e-12


def test_published_tail_probabilities():
    assert abs(chi2_sf(710.176, 22) / 5.536e-136 - 1) < 1e-3
    assert abs(chi2_sf(25.222, 2) - 3.3350e-06) < 1e-9
    assert chi2_sf(17354.555, 3) == 0.0
    assert abs(two_sided_from_cdf(4.457) - 8.311e-06) < 1e-8


def test_cliffs_delta_from_published_u():
    assert round(2 * 284412 / (317 * 2124) - 1, 4) == -0.1552


# --- fixtures ------------------------------------------------------------------
def test_yates_only_when_one_degree_of_freedom(spark):
    two = chi2_two_column(counts_df(spark, [("a", 10, 5), ("b", 4, 9)])).collect()[0]
    raw = chi2_two_column(counts_df(spark, [("a", 10, 5), ("b", 4, 9)]), yates=False).collect()[0]
    assert two.chi2 < raw.chi2 and abs(two.chi2_uncorrected - raw.chi2) < 1e-9
    three = chi2_two_column(counts_df(spark, [("a", 10, 5), ("b", 4, 9), ("c", 7, 7)])).collect()[0]
    assert abs(three.chi2 - three.chi2_uncorrected) < 1e-12


def test_chi2_matches_textbook_formula(spark):
    rng = random.Random(7)
    rows = [(f"r{i}", rng.randint(0, 50), rng.randint(1, 50)) for i in range(6)]
    r = chi2_two_column(counts_df(spark, rows)).collect()[0]
    n = sum(a + b for _, a, b in rows)
    c0, c1 = sum(a for _, a, _ in rows), sum(b for _, _, b in rows)
    expected = sum(
        (o - e) ** 2 / e
        for _, a, b in rows
        for o, e in ((a, (a + b) * c0 / n), (b, (a + b) * c1 / n))
    )
    assert abs(r.chi2 - expected) < 1e-8 * max(1.0, expected)


def test_single_stratum_mh_odds_ratio(spark):
    s = spark.createDataFrame([(10, 5, 3, 12)], "a long, b long, c long, d long")
    r = mantel_haenszel(s).collect()[0]
    assert abs(r.pooled_odds_ratio - 10 * 12 / (5 * 3)) < 1e-12


def test_mh_admission_rule(spark):
    s = spark.createDataFrame([(10, 5, 3, 12), (1, 0, 2, 3), (0, 9, 9, 9)], "a long, b long, c long, d long")
    assert mantel_haenszel(s, min_stratum_n=20).first().strata == 2


def test_benjamini_hochberg(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "k string, p double")
    out = {r.k: r.p_adjusted for r in benjamini_hochberg(t, "p", "k").collect()}
    assert {k: round(v, 10) for k, v in out.items()} == {"a": 0.02, "b": 0.04, "c": 0.04, "d": 0.02}


def test_mann_whitney_and_cliffs_delta(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 2), ("y", 3)], "g string, v int")
    r = rank_tests(df, "v", "g", "x", "y").collect()[0]
    assert r.mw_u == 1.0 and abs(r.cliffs_delta - (-2 / 3)) < 1e-12
    assert 0.0 < mann_whitney_p(r.mw_u, r.n1, r.n2, r.mw_tie_sum) <= 1.0


def test_kruskal_wallis_matches_definition(spark):
    rng = random.Random(3)
    data = [(g, rng.randint(0, 6)) for g in ("a", "b", "c") for _ in range(rng.randint(5, 12))]
    df = spark.createDataFrame(data, "g string, v int")
    r = rank_tests(df, "v", "g", "a", "c").collect()[0]
    s = pd.DataFrame(data, columns=["g", "v"])
    s["rank"] = s["v"].rank(method="average")
    n = len(s)
    h = 12 / (n * (n + 1)) * sum(g["rank"].sum() ** 2 / len(g) for _, g in s.groupby("g")) - 3 * (n + 1)
    ties = s["v"].value_counts()
    h /= 1 - sum(t**3 - t for t in ties) / (n**3 - n)
    assert abs(r.kw_h - h) < 1e-9


# --- properties ------------------------------------------------------------------
@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=4), min_size=1, max_size=40))
def test_tiles_match_pandas_and_ntile(spark, values):
    pdf = pd.DataFrame({"x": [float(v) for v in values], "order_id": range(len(values))})
    df = spark.createDataFrame(pdf)
    got_q = {r.order_id: r.tile for r in add_tiles(df, [F.col("x"), F.col("order_id")], 3, "qcut").collect()}
    if len(values) >= 3:
        ranks = pdf.sort_values(["x", "order_id"]).assign(rank=range(1, len(values) + 1)).set_index("order_id")["rank"]
        q = pd.qcut(ranks, 3, labels=[1, 2, 3]).astype(int)
        assert all(got_q[i] == q[i] for i in range(len(values)))
    got_n = add_tiles(df, [F.col("x"), F.col("order_id")], 3, "ntile").groupBy("tile").count().collect()
    sizes = sorted((r.tile, r["count"]) for r in got_n)
    counts = [c for _, c in sizes]
    assert max(counts) - min(counts) <= 1 and counts == sorted(counts, reverse=True)


@pytest.mark.parametrize("x", [0.5, 3.84, 10.0, 50.0])
@pytest.mark.parametrize("k", [1, 2, 3, 4, 7])
def test_chi2_sf_against_numeric_integration(x, k):
    # Survival function = 1 - regularised lower incomplete gamma; check by series of the lower part.
    a, y = k / 2.0, x / 2.0
    term = math.exp(-y + a * math.log(y) - math.lgamma(a + 1))
    lower, j = 0.0, 0
    while True:
        lower += term
        j += 1
        term *= y / (a + j)
        if term < 1e-18:
            break
    assert abs(chi2_sf(x, k) - (1 - lower)) < 1e-10


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(min_value=0.0, max_value=1.0, allow_nan=False), min_size=1, max_size=12))
def test_bh_adjusted_values_are_monotone_and_bounded(spark, ps):
    t = spark.createDataFrame([(f"k{i:02d}", p) for i, p in enumerate(ps)], "k string, p double")
    rows = sorted(benjamini_hochberg(t, "p", "k").collect(), key=lambda r: (r.p, r.k))
    adj = [r.p_adjusted for r in rows]
    assert all(a <= b + 1e-15 for a, b in zip(adj, adj[1:]))
    assert all(r.p - 1e-15 <= r.p_adjusted <= 1.0 for r in rows)


def test_mart_grain_and_bucket_population(spark):
    import __spark_entry__ as entry
    from conftest import SF01

    q = entry.queries()
    g = q["dq_granularity"](spark, SF01).first()
    assert g.duplicate_rows == 0 and g.all_rows == g.unique_orders
    buckets = sum(r.orders for r in q["delay_bucket_reviews"](spark, SF01).collect())
    mart = q["mart_order_fact"](spark, SF01)
    population = mart.where(
        "order_status = 'delivered' AND review_score IS NOT NULL AND delivery_delay_days IS NOT NULL"
    ).count()
    assert buckets == population


def test_mann_whitney_exact_small_samples():
    # Completely separated samples of three: exact two-sided p = 2 / C(6, 3).
    assert abs(mann_whitney_p(0.0, 3.0, 3.0, 0.0, "exact") - 0.1) < 1e-12
    # Unequal samples: enumerate all arrangements.
    ranks = range(17)
    n = hits = 0
    for chosen in itertools.combinations(ranks, 5):
        u = sum(chosen) - 10
        n += 1
        hits += max(u, 60 - u) >= 50
    assert abs(mann_whitney_p(10.0, 5.0, 12.0, 0.0, "exact") - hits / n) < 1e-12
    # The method does not depend on the sample size; ties rule the exact form out.
    assert abs(mann_whitney_p(10.0, 5.0, 12.0, 0.0) - 0.0398) < 5e-4
    assert 0.0 < mann_whitney_p(1.0, 3.0, 2.0, 6.0) < 1.0
    assert math.isnan(mann_whitney_p(1.0, 3.0, 2.0, 6.0, "exact"))


def test_rank_tests_degenerate_input(spark):
    schema = "v double, g string"
    for rows in ([], [(1.0, "Low")], [(2.0, "Low"), (2.0, "High"), (2.0, "High")]):
        r = rank_tests(spark.createDataFrame(rows, schema), "v", "g", "Low", "High").collect()[0]
        assert r.kw_h is None and r.n == len(rows)


def test_chi_square_large_counts(spark):
    cells = [("a", 10**11 + 100_000, 10**11), ("b", 10**11, 10**11 + 100_000)]
    r = chi2_two_column(spark.createDataFrame(cells, "row string, o0 long, o1 long"), yates=False).collect()[0]
    n, total = sum(a + b for _, a, b in cells), 0
    for _, a, b in cells:
        for o, c in ((a, sum(x for _, x, _ in cells)), (b, sum(x for _, _, x in cells))):
            e = Fraction((a + b) * c, n)
            total += (o - e) ** 2 / e
    assert abs(r.chi2_uncorrected - float(total)) < 1e-6


def test_chi_square_tail_large_dof():
    assert abs(chi2_sf(100_000.0, 100_000) - 0.4994) < 1e-3
    assert chi2_sf(1e6, 3) == 0.0
    assert abs(chi2_sf(5.281, 2) - math.exp(-5.281 / 2)) < 1e-15


# Published state x lateness table (state, late orders, late low-review %,
# on-time orders, on-time low-review %).
STATE_LATENESS = [
    ("AL", 92, 60.87, 302, 8.94), ("BA", 443, 53.72, 2786, 11.2), ("CE", 194, 63.4, 1079, 8.8),
    ("DF", 147, 59.86, 1923, 9.46), ("ES", 234, 50.0, 1735, 8.88), ("GO", 155, 52.26, 1791, 9.72),
    ("MA", 137, 58.39, 575, 10.78), ("MG", 622, 49.84, 10663, 9.48), ("MS", 81, 51.85, 618, 8.25),
    ("MT", 58, 48.28, 821, 10.23), ("PA", 111, 66.67, 822, 11.31), ("PB", 55, 58.18, 457, 9.63),
    ("PE", 168, 64.29, 1411, 8.93), ("PI", 75, 57.33, 396, 8.33), ("PR", 241, 43.98, 4659, 9.12),
    ("RJ", 1623, 66.85, 10588, 10.85), ("RN", 50, 66.0, 421, 6.65), ("RO", 7, 57.14, 235, 10.64),
    ("RS", 378, 55.56, 4948, 8.55), ("SC", 339, 51.62, 3180, 8.9), ("SE", 50, 68.0, 284, 10.21),
    ("SP", 2349, 44.57, 37917, 8.54), ("TO", 35, 37.14, 238, 8.4),
]


def test_h5b_published_mantel_haenszel(spark):
    rows = []
    for _, late, late_pct, on_time, on_time_pct in STATE_LATENESS:
        low_late, low_on_time = round(late * late_pct / 100), round(on_time * on_time_pct / 100)
        # rows late 0/1 x columns low 0/1
        rows.append((on_time - low_on_time, low_on_time, late - low_late, low_late))
    strata = spark.createDataFrame(rows, "a long, b long, c long, d long")
    r = mantel_haenszel(strata, min_stratum_n=20).collect()[0]
    assert r.strata == 23
    assert round(r.mh_statistic, 3) == 11479.747
    assert round(r.pooled_odds_ratio, 2) == 11.28


def test_global_running_sums_match_cumsum(spark):
    from ordersight.operators.tiles import global_running_sums

    rng = random.Random(11)
    rows = [(i, rng.randint(0, 9), rng.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a long, b long").repartition(7)
    got = {r.k: (r.cum_a, r.cum_b) for r in global_running_sums(df, [F.col("k")], ["a", "b"]).collect()}
    ca = cb = 0
    for k, a, b in rows:
        ca, cb = ca + a, cb + b
        assert got[k] == (ca, cb)


def test_global_running_min_and_bh_on_many_tests(spark):
    from ordersight.operators.tiles import global_running

    rng = random.Random(5)
    rows = [(i, rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, p double").repartition(9)
    got = {r.k: r.cum_p for r in global_running(df, [F.col("k").desc()], ["p"], "min").collect()}
    running = float("inf")
    for k, p in sorted(rows, reverse=True):
        running = min(running, p)
        assert got[k] == running
    # BH against a direct computation on 400 tests.
    out = {r.k: r.p_adjusted for r in benjamini_hochberg(df.withColumn("k", F.col("k").cast("string")), "p", "k").collect()}
    order = sorted(rows, key=lambda r: (r[1], str(r[0])))
    m, best, want = len(order), 1.0, {}
    for i in range(m, 0, -1):
        k, p = order[i - 1]
        best = min(best, p * m / i)
        want[str(k)] = best
    assert all(abs(out[k] - v) < 1e-12 for k, v in want.items())
