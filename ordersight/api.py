"""Public analysis API (K5): DataFrame in, DataFrame out.

Counterparts of the helpers the reference's notebook imports, re-aimed at
distributed DataFrames: statistic helpers take long count tables, not arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions.columns import ALPHA, delay_bucket  # noqa: F401
from ordersight.operators.contingency import chi2_two_column, two_column_counts
from ordersight.operators.contingency import cochran_armitage as _trend
from ordersight.operators.mart import build_mart, delivered_reviewed  # noqa: F401
from ordersight.operators.ranks import rank_tests


def build_mart_order_fact(raw: dict[str, DataFrame]) -> DataFrame:
    """The order-level fact table from the six raw tables."""
    return build_mart(raw)


def contingency_counts(df: DataFrame, row: str, flag: str) -> DataFrame:
    """Long r x 2 counts ``(row, o0, o1)`` of a 0/1 outcome."""
    return two_column_counts(df, row, flag)


def cramers_v(counts: DataFrame) -> DataFrame:
    """One row: Cramér's V (from the uncorrected chi-square) of an r x 2 count table."""
    return chi2_two_column(counts, yates=False).select("cramers_v")


def cochran_armitage(counts: DataFrame, score: str = "row") -> DataFrame:
    """One row: two-sided Cochran-Armitage ``trend_z`` and ``p_value`` (``o1`` = outcome of interest)."""
    return _trend(counts, score)


def odds_ratio_2x2(cells: DataFrame) -> DataFrame:
    """Per row of cells ``a, b, c, d`` (table [[a, b], [c, d]]): a*d / (b*c), NULL when b*c = 0."""
    bc = F.col("b").cast("double") * F.col("c")
    return cells.withColumn("odds_ratio", F.when(bc > 0, F.col("a").cast("double") * F.col("d") / bc))


def cliff_delta(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """One row: Cliff's delta of ``first`` vs ``second`` (from U, no pairwise work)."""
    return rank_tests(df, value, group, first, second).select("cliffs_delta")
