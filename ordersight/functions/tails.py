"""Tail probabilities of the chi-square and normal distributions.

Spark SQL has no incomplete-gamma or error function; both are folds of built-in
functions here (``chi2_tail``, ``normal_two_sided``, ``mann_whitney_tail``, written as SQL
text over column names), so no Python runs on executors.  With a = k/2 and y = x/2 for k whole degrees of freedom:

- up to y = a the lower tail is the power series
  ``y^a e^-y / Gamma(a+1) * (1 + y/(a+1) + y^2/((a+1)(a+2)) + ...)``, as many terms as its
  slowest case needs (some multiple of the square root of a);
- above, the upper tail is finite, a sum of positive terms
  ``y^j e^-y / Gamma(j+1)`` for j = a-1, a-2, ..., ending at 0 (even k), or at 1/2
  with the tail of one degree of freedom added (odd k);
- the tail of one degree of freedom, ``erfc(sqrt(y))``, is one minus the power series for small y,
  and a continued fraction evaluated from its end for larger y.

The scale is kept in log space, so extreme tails underflow to 0.0.  NULL or NaN
arguments give NULL.

The scalar functions below are the same definitions for the driver, and for the
exact distribution of U.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SQRT_HALF = math.sqrt(0.5)

#: Terms of the continued fraction; 60 give full precision from y = 1.5 on.
_FRACTION = 60


def _let(name: str, value: str, use: str) -> str:
    """``use`` with ``name`` standing for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def _log_gamma(a: str) -> str:
    """log Gamma of a positive multiple of one half."""
    whole = f"floor({a}) = {a}"
    least = f"if({whole}, 1D, 0.5D)"
    # an index below the argument is a factor; the last one, which is not, keeps the sequence from being empty
    steps = f"sequence(0, greatest(0, cast({a} - {least} AS INT)))"
    start = f"if({whole}, 0D, {0.5 * math.log(math.pi)!r}D)"
    return f"aggregate({steps}, {start}, (acc, i) -> acc + if({least} + i < {a}, ln({least} + i), 0D))"


def _series(a: str, y: str) -> str:
    """1 + y/(a+1) + y^2/((a+1)(a+2)) + ... for y <= a + 1."""
    return (
        f"aggregate(sequence(1, cast(60 + 20 * sqrt({a}) AS INT)), named_struct('term', 1D, 'total', 1D), (acc, i) -> "
        f"named_struct('term', acc.term * {y} / ({a} + i), 'total', acc.total + acc.term * {y} / ({a} + i)), acc -> acc.total)"
    )


def _one_degree(y: str) -> str:
    """erfc(sqrt(y)); ``y`` is a name."""
    power = f"exp(0.5D * ln({y}) - {y})"
    lower = f"1D - {power} / {0.5 * math.sqrt(math.pi)!r}D * {_series('0.5D', y)}"
    # sqrt(y) e^-y / sqrt(pi) / (y + 1/2 / (1 + 1 / (y + 3/2 / (1 + 2 / (y + ...)))))
    fraction = f"aggregate(sequence({_FRACTION}, 1, -1), {y}, (acc, i) -> {y} + (i - 0.5D) / (1D + i / acc))"
    upper = f"{power} / {math.sqrt(math.pi)!r}D / {fraction}"
    return f"CASE WHEN {y} <= 0 THEN 1D WHEN {y} < 1.5 THEN {lower} ELSE {upper} END"


def _known(*names: str) -> str:
    return " AND ".join(f"{n} IS NOT NULL AND NOT isnan({n})" for n in names)


def chi2_tail_sql(x: str, k: str) -> str:
    """P(X > x) for X ~ chi-square with a whole number ``k`` of degrees of freedom; SQL expressions."""
    whole = "floor(v.a) = v.a"
    # from the largest power down; the last power is 0 or 1/2
    count = f"greatest(0, cast(v.a - if({whole}, 0D, 0.5D) AS INT))"
    upper = (
        f"aggregate(sequence(1, greatest(1, {count})), "
        f"named_struct('term', if({count} > 0, exp((v.a - 1) * ln(v.y) - v.y - v.lg), 0D), 'total', 0D), "
        f"(acc, i) -> named_struct('term', acc.term * (v.a - i) / v.y, 'total', acc.total + acc.term), acc -> acc.total) "
        f"+ if({whole}, 0D, {_one_degree('v.y')})"
    )
    lower = f"1D - exp(v.a * ln(v.y) - v.y - v.lg - ln(v.a)) * {_series('v.a', 'v.y')}"
    tail = f"least(1D, greatest(0D, CASE WHEN v.y > v.a THEN {upper} ELSE {lower} END))"
    some = _let("v", f"named_struct('a', w.k / 2D, 'y', w.x / 2D, 'lg', {_log_gamma('(w.k / 2D)')})", tail)
    found = f"CASE WHEN {_known('w.x', 'w.k')} THEN CASE WHEN w.k <= 0 OR w.x <= 0 THEN 1D ELSE {some} END END"
    return _let("w", f"named_struct('x', cast({x} AS DOUBLE), 'k', round(cast({k} AS DOUBLE)))", found)


def normal_two_sided_sql(z: str) -> str:
    """``2 * (1 - cdf(|z|))`` with the cancellation of that form, as the trend test's p-value is published."""
    both = _let("y", f"cast({z} AS DOUBLE) * {z} / 2D", f"CASE WHEN {_known('y')} THEN 2D * (1D - (1D - 0.5D * ({_one_degree('y')}))) END")
    return both


def mann_whitney_tail_sql(u1: str, n1: str, n2: str, tie_sum: str) -> str:
    """Two-sided asymptotic Mann-Whitney p with tie and continuity corrections; NULL without spread."""
    given = ", ".join(f"'{name}', cast({value} AS DOUBLE)" for name, value in (("u", u1), ("m", n1), ("n", n2), ("t", tie_sum)))
    ties = "try_divide(g.t, (g.m + g.n) * (g.m + g.n - 1))"
    spread = f"sqrt(greatest(0D, g.m * g.n / 12D * (g.m + g.n + 1 - {ties})))"
    z = f"try_divide(greatest(g.u, g.m * g.n - g.u) - g.m * g.n / 2D - 0.5D, {spread})"
    # z is slightly below 0 where U is its mean
    p = _let("z", z, f"CASE WHEN z >= 0 THEN {_let('y', 'z * z / 2D', _one_degree('y'))} WHEN z < 0 THEN 1D END")
    known = _known("g.u", "g.m", "g.n", "g.t")
    return _let("g", f"named_struct({given})", f"CASE WHEN {known} AND g.m >= 1 AND g.n >= 1 THEN {p} END")


def chi2_tail(x: str, k: str) -> Column:
    return F.expr(chi2_tail_sql(x, k))


def normal_two_sided(z: str) -> Column:
    return F.expr(normal_two_sided_sql(z))


def mann_whitney_tail(u1: str, n1: str, n2: str, tie_sum: str) -> Column:
    return F.expr(mann_whitney_tail_sql(u1, n1, n2, tie_sum))


def p_value_of(kind: str, a: str, b: str, c: str, d: str) -> Column:
    """The p-value of a kind of test: 'chi2' (a=statistic, b=dof), 'trend' (a=z),
    'mw' (a=U, b=n1, c=n2, d=tie sum); NULL for others.  Arguments are column names."""
    return F.expr(
        f"CASE {kind} WHEN 'chi2' THEN {chi2_tail_sql(a, b)} WHEN 'trend' THEN {normal_two_sided_sql(a)} "
        f"WHEN 'mw' THEN {mann_whitney_tail_sql(a, b, c, d)} END"
    )


def chi2_sf(x: float, k: float) -> float:
    """P(X > x) for X ~ chi-square with integer ``k`` degrees of freedom."""
    if x is None or k is None or (isinstance(x, float) and math.isnan(x)) or (isinstance(k, float) and math.isnan(k)):
        return float("nan")
    k = int(round(k))
    if k <= 0 or x <= 0:
        return 1.0
    a, y = k / 2.0, x / 2.0
    scale = a * math.log(y) - y - math.lgamma(a)  # log of y^a e^-y / Gamma(a)
    if y < a + 1.0:
        # lower tail: sum of y^j / (a (a+1) ... (a+j))
        term = total = 1.0 / a
        j = a
        while term > total * 1e-17:
            j += 1.0
            term *= y / j
            total += term
        return min(1.0, max(0.0, 1.0 - total * math.exp(scale)))
    # upper tail: continued fraction, evaluated forwards until a factor is 1
    tiny = 1e-300
    b = y + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    i = 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return min(1.0, math.exp(scale + math.log(h)))


def normal_cdf(z: float) -> float:
    """Standard normal CDF with the classic erf / erfc split at |z| = 1."""
    x = z * _SQRT_HALF
    if abs(x) < _SQRT_HALF:
        return 0.5 + 0.5 * math.erf(x)
    y = 0.5 * math.erfc(abs(x))
    return 1.0 - y if x > 0 else y


def two_sided_from_cdf(z: float) -> float:
    """``2 * (1 - cdf(|z|))`` - the trend test's p-value as the reference forms it."""
    if z is None or math.isnan(z):
        return float("nan")
    return 2.0 * (1.0 - normal_cdf(abs(z)))


def two_sided_sf(z: float) -> float:
    """``2 * sf(|z|)`` computed from the upper tail (no cancellation)."""
    if z is None or math.isnan(z):
        return float("nan")
    return min(1.0, math.erfc(abs(z) * _SQRT_HALF))


def mann_whitney_exact_p(u1: float, n1: int, n2: int) -> float:
    """Exact two-sided p without ties: 2 * P(U >= max(U1, U2)).

    The counts of U are the coefficients of the Gaussian binomial
    prod_i (1 - q^(n2+i)) / (1 - q^i): one list of n1 * n2 + 1 integers.
    """
    small, large = sorted((int(n1), int(n2)))
    counts = [1] + [0] * (small * large)
    for i in range(1, small + 1):
        up = large + i
        for u in range(len(counts) - 1, up - 1, -1):
            counts[u] -= counts[u - up]
        for u in range(i, len(counts)):
            counts[u] += counts[u - i]
    u = int(round(max(u1, n1 * n2 - u1)))
    return min(1.0, 2.0 * sum(counts[u:]) / sum(counts))


def mann_whitney_p(u1: float, n1: float, n2: float, tie_sum: float, method: str = "asymptotic") -> float:
    """Two-sided Mann-Whitney p.

    ``asymptotic`` (default, at every sample size): normal with tie and continuity
    corrections.  ``exact``: the distribution of U without ties, on request only;
    with ties it does not hold and gives NaN.
    """
    if method not in ("asymptotic", "exact"):
        raise ValueError(f"unknown method {method!r}")
    if any(v is None or math.isnan(v) for v in (u1, n1, n2, tie_sum)) or n1 < 1 or n2 < 1:
        return float("nan")
    if method == "exact":
        return mann_whitney_exact_p(u1, int(n1), int(n2)) if tie_sum == 0 else float("nan")
    n = n1 + n2
    u = max(u1, n1 * n2 - u1)
    s = math.sqrt(max(0.0, n1 * n2 / 12.0 * ((n + 1) - tie_sum / (n * (n - 1)))))
    if s == 0:
        return float("nan")
    z = (u - n1 * n2 / 2.0 - 0.5) / s
    return min(1.0, max(0.0, 2.0 * 0.5 * math.erfc(z * _SQRT_HALF)))
