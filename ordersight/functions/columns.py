"""Column-level helpers: labels, flags, exact rounding and day counts.

Everything here is a plain ``Column`` expression, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Labels and their display order, as the analyses print them.
# ---------------------------------------------------------------------------
ON_TIME = "On time or early"
LATE_1_3 = "1-3 days late"
LATE_4_7 = "4-7 days late"
LATE_8P = "8+ days late"
DELAY_BUCKETS = [ON_TIME, LATE_1_3, LATE_4_7, LATE_8P]

LATE = "Late"
DELIVERY_STATUSES = [LATE, ON_TIME]

REVIEW_LOW = "Low review (1-2)"
REVIEW_NEUTRAL = "Neutral review (3)"
REVIEW_HIGH = "High review (4-5)"
REVIEW_GROUPS = [REVIEW_LOW, REVIEW_NEUTRAL, REVIEW_HIGH]
SHORT_REVIEW_GROUPS = ["Low", "Neutral", "High"]

FREIGHT_BUCKETS = ["Low freight ratio", "Mid freight ratio", "High freight ratio"]
FREIGHT_SHORT = ["Low", "Mid", "High"]

MULTI_ITEM, SINGLE_ITEM = "Multi-item", "Single-item"
MULTI_SELLER, SINGLE_SELLER = "Multi-seller", "Single-seller"

DEFAULT_CUTOFF = "2018-07-01"
ALPHA = 0.05


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Flags (P3, P4, P5)
# ---------------------------------------------------------------------------
def late_flag(delivered: str | Column, estimated: str | Column) -> Column:
    """1 / 0 / NULL: NULL when not delivered, 1 when delivered after the estimate."""
    d, e = col(delivered), col(estimated)
    return F.when(d.isNull(), F.lit(None).cast("int")).when(d > e, F.lit(1)).otherwise(F.lit(0))


def low_review_flag(score: str | Column) -> Column:
    """1 / 0 / NULL: NULL without a review, 1 when the score is at most 2."""
    s = col(score)
    return F.when(s.isNull(), F.lit(None).cast("int")).when(s <= 2, F.lit(1)).otherwise(F.lit(0))


# ---------------------------------------------------------------------------
# Labels (P6 - P10)
# ---------------------------------------------------------------------------
def delay_bucket(days: str | Column) -> Column:
    d = col(days)
    return (
        F.when(d <= 0, F.lit(ON_TIME))
        .when(d.between(1, 3), F.lit(LATE_1_3))
        .when(d.between(4, 7), F.lit(LATE_4_7))
        .when(d > 7, F.lit(LATE_8P))
    )


def delay_bucket_ordinal(days: str | Column) -> Column:
    d = col(days)
    return F.when(d <= 0, 0).when(d <= 3, 1).when(d <= 7, 2).when(d > 7, 3)


def review_group_sql(score: str | Column) -> Column:
    """SQL grouping: <=2, =3, >=4; fractional 2.5 / 3.5 fall into a NULL group."""
    s = col(score)
    return (
        F.when(s <= 2, F.lit(REVIEW_LOW))
        .when(s == 3, F.lit(REVIEW_NEUTRAL))
        .when(s >= 4, F.lit(REVIEW_HIGH))
    )


def review_group_cut(score: str | Column, labels=REVIEW_GROUPS) -> Column:
    """Interval binning (-inf, 2], (2, 3], (3, inf): 2.5 -> middle, 3.5 -> high."""
    s = col(score)
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s <= 2, F.lit(labels[0]))
        .when(s <= 3, F.lit(labels[1]))
        .otherwise(F.lit(labels[2]))
    )


def label_ordinal(label: str | Column, labels: list[str]) -> Column:
    """Position (1-based) of a label in a fixed display order."""
    expr = None
    c = col(label)
    for i, name in enumerate(labels, start=1):
        expr = F.when(c == name, F.lit(i)) if expr is None else expr.when(c == name, F.lit(i))
    return expr


def delivery_status(late: str | Column) -> Column:
    return F.when(col(late) == 1, F.lit(LATE)).otherwise(F.lit(ON_TIME))


def tercile_label(tile: str | Column, labels=FREIGHT_BUCKETS) -> Column:
    t = col(tile)
    return F.when(t == 1, labels[0]).when(t == 2, labels[1]).when(t == 3, labels[2])


def item_complexity(item_count: str | Column) -> Column:
    return F.when(col(item_count) > 1, F.lit(MULTI_ITEM)).otherwise(F.lit(SINGLE_ITEM))


def seller_complexity(seller_count: str | Column) -> Column:
    return F.when(col(seller_count) > 1, F.lit(MULTI_SELLER)).otherwise(F.lit(SINGLE_SELLER))


# ---------------------------------------------------------------------------
# Exact rounding
# ---------------------------------------------------------------------------
def round_ratio(num: str | Column, den: str | Column, digits: int) -> Column:
    """``num / den`` rounded half up to ``digits`` decimals, NULL when ``den`` is 0.

    Computed as ``floor((2 * 10^d * num + den) / (2 * den)) / 10^d`` so that an
    exact (integer or half-integer) numerator is rounded from its exact value,
    not from the binary approximation of the quotient.
    """
    scale = 10**digits
    n = col(num).cast("double")
    d = col(den).cast("double")
    q = F.floor((F.lit(2.0 * scale) * n + d) / (F.lit(2.0) * d))
    return F.when(d == 0, F.lit(None).cast("double")).otherwise(q.cast("double") / F.lit(float(scale)))


def rate_pct(events: str | Column, total: str | Column, digits: int = 2) -> Column:
    """Percentage ``100 * events / total`` rounded half up."""
    return round_ratio(col(events).cast("double") * F.lit(100.0), total, digits)


def round_half_up(x: str | Column, digits: int) -> Column:
    """Half-up rounding of an inexact double, ``floor(x * 10^d + 0.5) / 10^d``."""
    scale = float(10**digits)
    return F.floor(col(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


# ---------------------------------------------------------------------------
# Day counts
# ---------------------------------------------------------------------------
def calendar_days(end: str | Column, start: str | Column) -> Column:
    """Calendar-day difference of the date parts (SQL ``DATEDIFF``)."""
    return F.datediff(col(end), col(start))


def elapsed_days(end: str, start: str) -> Column:
    """Whole elapsed days, floored (pandas ``(end - start).dt.days``).

    ``timestampdiff`` on ``timestamp_ntz`` values counts wall-clock seconds, so
    the result does not depend on the session time zone.
    """
    secs = F.expr(f"timestampdiff(SECOND, `{start}`, `{end}`)")
    return F.floor(secs / F.lit(86400)).cast("int")
