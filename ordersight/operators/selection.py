"""Exact order statistics by narrowing histograms, without sorting the data.

The rows at given positions of a global order are found by counting:

1. One aggregate gives the row count and, from mergeable quantile sketches, a bracket
   of two values around every position (a histogram whose edges follow the data).
2. One aggregate counts the rows below, on and above the brackets' ends, exactly.
   The position then lies on an end or strictly between the two ends.
3. Brackets of few rows (``FEW``) are sorted as an array; larger ones are narrowed again, each
   round leaving a small share of the rows.  Where a single value holds many rows, the
   next column of the order is narrowed among them: numbers as they are, strings
   by six bytes at a time, in their binary order.

Only counts, bracket ends and the rows at the positions reach the driver; the data is
neither shuffled, sorted nor stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Relative accuracy of the sketches (1 / ACCURACY of the rows).
ACCURACY = 10_000

#: Rows of a bracket that are sorted in one array.
FEW = 10_000

#: Six bytes are exact in a double.
_BYTES = 6
_LOWEST = float("-inf")


def _levels(df: DataFrame, order_cols: list[Column]) -> Iterator[Column]:
    """Numeric columns that refine the order step by step (NULL sorts first)."""
    for c, field in zip(order_cols, df.select(*order_cols).schema.fields):
        if isinstance(field.dataType, StringType):
            for at in range(0, 8 * _BYTES, _BYTES):
                part = F.rpad(F.hex(F.substring(c.cast("binary"), at + 1, _BYTES)), 2 * _BYTES, "0")
                yield F.coalesce(F.conv(part, 16, 10).cast("double"), F.lit(_LOWEST))
        else:
            yield F.coalesce(c.cast("double"), F.lit(_LOWEST))


def _sketch(level: Column, shares: list[float]) -> Column:
    return F.percentile_approx(level, [min(1.0, max(0.0, s)) for s in shares], ACCURACY)


def _ends(shares: list[float]) -> list[float]:
    return [s + d for s in shares for d in (-3.0 / ACCURACY, 3.0 / ACCURACY)]


def _counts(level: Column, lo: float, hi: float) -> list[Column]:
    return [F.count_if(level < lo), F.count_if(level <= lo), F.count_if(level < hi), F.count_if(level <= hi)]


def _inside(level: Column, lo: float, hi: float, counts: list[int], n: int, position: int) -> tuple[Column, int, int, bool]:
    """(condition of the rows that may hold the position, rows before them, their number, whether they share a value)."""
    below_lo, to_lo, below_hi, to_hi = counts
    if position <= below_lo:
        return level < lo, 0, below_lo, False
    if position <= to_lo:
        return level == lo, below_lo, to_lo - below_lo, True
    if position <= below_hi:
        return (level > lo) & (level < hi), to_lo, below_hi - to_lo, False
    if position <= to_hi:
        return level == hi, below_hi, to_hi - below_hi, True
    return level > hi, to_hi, n - to_hi, False


def _narrowed(df: DataFrame, levels: list[Column], n: int, position: int, single: bool) -> tuple[DataFrame, int]:
    """The few rows around ``position`` and the position among them."""
    at = 1 if single else 0
    while n > FEW and at < len(levels):
        level = levels[at]
        lo, hi = df.agg(_sketch(level, _ends([position / n])).alias("e")).first()["e"]
        counts = list(df.agg(*[c.alias(f"c{i}") for i, c in enumerate(_counts(level, lo, hi))]).first())
        keep, before, n, single = _inside(level, lo, hi, counts, n, position)
        df, position = df.where(keep), position - before
        at += single
    return df, position


def rows_at(
    df: DataFrame, order_cols: list[Column], positions_of: Callable[[int], dict[str, tuple[float, int]]]
) -> tuple[int, dict[str, tuple]]:
    """The row count and, per name, the values of ``order_cols`` at a 1-based position of their order.

    ``positions_of(n)`` names (share, position): the share of the rows, about position / n,
    must not depend on n.  Positions outside 1..n give no entry.
    """
    levels = list(_levels(df, order_cols))
    shares = sorted({share for share, _ in positions_of(0).values()})
    head = df.agg(F.count(F.lit(1)).alias("n"), _sketch(levels[0], _ends(shares)).alias("e")).first()
    n = head["n"]
    wanted = {name: (share, at) for name, (share, at) in positions_of(n).items() if 1 <= at <= n}
    if not wanted:
        return n, {}
    row = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order_cols)])
    brackets = {s: (head["e"][2 * i], head["e"][2 * i + 1]) for i, s in enumerate(shares)}
    places: dict[str, tuple[Column | None, int]] = {}
    if n <= FEW:
        places = {name: (None, at) for name, (_, at) in wanted.items()}
    else:
        counted = list(df.agg(*[c.alias(f"c{s}_{i}") for s in shares for i, c in enumerate(_counts(levels[0], *brackets[s]))]).first())
        by_share = {s: counted[4 * i : 4 * i + 4] for i, s in enumerate(shares)}
        far = {}
        for name, (share, at) in wanted.items():
            keep, before, size, single = _inside(levels[0], *brackets[share], by_share[share], n, at)
            if size <= FEW:
                places[name] = (keep, at - before)
            else:
                far[name] = _narrowed(df.where(keep), levels, size, at - before, single)
    found: dict[str, tuple] = {}
    if places:
        picks = [
            F.element_at(F.sort_array(F.collect_list(row if keep is None else F.when(keep, row))), at).alias(name)
            for name, (keep, at) in places.items()
        ]
        found |= {name: tuple(r) for name, r in df.agg(*picks).first().asDict().items()}
    if n > FEW:
        for name, (rest, at) in far.items():
            found[name] = tuple(rest.agg(F.element_at(F.sort_array(F.collect_list(row)), at).alias("r")).first()["r"])
    return n, found


def after(order_cols: list[Column], cut: tuple | None) -> Column:
    """Whether a row comes after the row ``cut`` in the order; every row comes after None."""
    if cut is None:
        return F.lit(True)
    later = F.lit(False)
    for c, value in reversed(list(zip(order_cols, cut))):
        if value is None:
            later = F.when(c.isNull(), later).otherwise(F.lit(True))
        else:
            later = F.coalesce(F.when(c > F.lit(value), True).when(c == F.lit(value), later), F.lit(False))
    return later
