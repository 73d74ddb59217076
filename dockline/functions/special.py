"""Closed-form finishers for test statistics.

Spark has no error function, incomplete gamma or incomplete beta, so p-values,
power and critical values of an already aggregated frame (a row per comparison)
are finished by small vectorised functions. All sums over data happen in Spark.
"""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()


def normal_sf(z: float) -> float:
    """Upper tail of the standard normal, accurate far out."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def two_sided_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_sf(x: float, dof: float) -> float:
    """Upper regularised gamma Q(dof/2, x/2): series below a+1, continued fraction above."""
    if dof <= 0:
        return 1.0
    if x <= 0:
        return 1.0
    a, y = dof / 2.0, x / 2.0
    front = math.exp(-y + a * math.log(y) - math.lgamma(a))
    if y < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= y / k
            total += term
        return max(0.0, 1.0 - front * total)
    # continued fraction, evaluated forward with rescaled convergents
    tiny = 1e-300
    b = y + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            return front * h
    return math.nan  # not converged: no value rather than a wrong one


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_ratio(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (tiny if abs(d) < tiny else d)
    h = d
    for m in range(1, 100_000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = tiny if abs(d) < tiny else d
            c = 1.0 + top / c
            c = tiny if abs(c) < tiny else c
            d = 1.0 / d
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-15:
            return front * h / a
    return math.nan


def two_sided_t(t: float, dof: float) -> float:
    """Two-sided p-value; the tail is computed directly, not as one minus a body."""
    if dof <= 0 or math.isnan(t):
        return math.nan
    x = dof / (dof + t * t)
    # I_x with small x stays on the accurate branch of the fraction
    return beta_ratio(dof / 2.0, 0.5, x)


def t_quantile(p: float, dof: float) -> float:
    """Upper quantile for p > 0.5 by bisection on the two-sided tail."""
    tail = 2.0 * (1.0 - p)
    low, high = 0.0, 2.0
    while two_sided_t(high, dof) > tail:
        high *= 2.0
        if high > 1e12:
            return math.inf
    for _ in range(200):
        mid = 0.5 * (low + high)
        if two_sided_t(mid, dof) > tail:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


def normal_power(h: float, n1: float, n2: float, alpha: float) -> float:
    """Two-sided power of the two-sample normal test at standardised effect h."""
    shift = abs(h) * math.sqrt(n1 * n2 / (n1 + n2))
    crit = normal_quantile(1.0 - alpha / 2.0)
    return normal_sf(crit - shift) + normal_sf(crit + shift)


def cohens_h(p_from: float, p_to: float) -> float:
    return 2.0 * math.asin(math.sqrt(p_to)) - 2.0 * math.asin(math.sqrt(p_from))


def detectable_h(n1: float, n2: float, alpha: float, power: float) -> float:
    """Effect at which the realised sizes reach the power, by bisection."""
    low, high = 0.0, 1.0
    while normal_power(high, n1, n2, alpha) < power:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        if normal_power(mid, n1, n2, alpha) < power:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


def detectable_points(baseline: float, n1: float, n2: float, alpha: float, power: float) -> float:
    """Smallest detectable difference in percentage points above the baseline rate."""
    h = detectable_h(n1, n2, alpha, power)
    rate = math.sin(math.asin(math.sqrt(baseline)) + h / 2.0) ** 2
    return 100.0 * (rate - baseline)


def size_per_arm(p_from: float, p_to: float, alpha: float, power: float) -> float:
    """Rows per arm that reach the power; null for no difference."""
    h = abs(cohens_h(p_from, p_to))
    if h == 0:
        return math.nan
    low, high = 1e-9, 1.0
    while normal_power(h, high, high, alpha) < power:
        high *= 2.0
    for _ in range(200):
        mid = 0.5 * (low + high)
        if normal_power(h, mid, mid, alpha) < power:
            low = mid
        else:
            high = mid
    return math.ceil(0.5 * (low + high))


EXACT_SMALL_ARM = 8


_SERIES: dict[int, tuple[int, list[int]]] = {}


def _partition_series(parts: int) -> tuple[int, list[int]]:
    """(L, A) with A(q) / (1 - q^L)^(parts + 1) = 1 / ((1 - q)(1 - q)(1 - q^2)...(1 - q^parts)).

    L is the least common multiple of 1..parts, so each factor 1 / (1 - q^i) is a
    polynomial over 1 - q^L, and A has a length that no sample size changes.
    """
    if parts in _SERIES:
        return _SERIES[parts]
    period = math.lcm(*range(1, parts + 1))
    series = [1]
    for i in (1, *range(1, parts + 1)):
        longer = [0] * (len(series) + period - i)
        for start in range(0, period, i):
            for k, value in enumerate(series):
                longer[start + k] += value
        series = longer
    _SERIES[parts] = (period, series)
    return period, series


def _partitions_up_to(total: int, parts: int) -> int:
    """Number of partitions of 0, 1, ..., total into at most `parts` parts."""
    if total < 0:
        return 0
    period, series = _partition_series(parts)
    return sum(
        series[j] * math.comb((total - j) // period + parts, parts)
        for j in range(total % period, min(total, len(series) - 1) + 1, period)
    )


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p-value without ties, from exact integers.

    The orderings with statistic s are the partitions of s into at most k parts of
    at most m (k, m the smaller and larger arm). Bounding the parts subtracts the
    expansion of (1 - q^(m+1))...(1 - q^(m+k)): at most 2^k terms, each with a count
    of unbounded partitions in closed form. The cost does not grow with m.
    """
    small, large = min(n1, n2), max(n1, n2)
    tail = small * large - math.ceil(max(u, n1 * n2 - u))
    excess = {0: 1}
    for i in range(1, small + 1):
        for shift, sign in list(excess.items()):
            excess[shift + large + i] = excess.get(shift + large + i, 0) - sign
    count = sum(sign * _partitions_up_to(tail - shift, small) for shift, sign in excess.items())
    return min(1.0, 2 * count / math.comb(small + large, small))


def rank_sum_p(u: float, n1: float, n2: float, ties: float) -> float:
    """Two-sided p-value of the rank-sum test.

    ``ties`` is the sum of t^3 - t over groups of equal values. The exact law is
    used without ties when the smaller arm has at most ``EXACT_SMALL_ARM`` rows;
    otherwise the normal approximation with tie and continuity correction.
    """
    if n1 < 1 or n2 < 1:
        return math.nan
    if ties == 0 and min(n1, n2) <= EXACT_SMALL_ARM:
        return rank_sum_exact(u, int(n1), int(n2))
    n = n1 + n2
    variance = n1 * n2 / 12.0 * ((n + 1.0) - ties / (n * (n - 1.0)))
    if variance <= 0:
        return math.nan
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / math.sqrt(variance)
    return min(1.0, 2.0 * normal_sf(z))


def _finisher(function):
    """Vectorised column function from a scalar one; a null input gives null."""

    def finish(frame: pd.DataFrame) -> pd.Series:
        rows = frame.astype("float64").itertuples(index=False, name=None)
        values = [None if any(v != v for v in row) else function(*row) for row in rows]
        return pd.Series(values, dtype="float64")

    vectorised = F.pandas_udf(finish, T.DoubleType())

    def column(*inputs: Column | str) -> Column:
        parts = [F.col(i) if isinstance(i, str) else i for i in inputs]
        named = [part.cast("double").alias(f"x{i}") for i, part in enumerate(parts)]
        return vectorised(F.struct(*named))

    return column


# Workers need no installed copy of this package to run the finishers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

normal_p = _finisher(two_sided_normal)
chi2_p = _finisher(chi2_sf)
t_p = _finisher(two_sided_t)
t_critical = _finisher(t_quantile)
power_of = _finisher(normal_power)
detectable = _finisher(detectable_points)
arm_size = _finisher(size_per_arm)
rank_p = _finisher(rank_sum_p)
