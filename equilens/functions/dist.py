"""Distribution functions on numpy arrays, and as Arrow functions for small metric frames.

Incomplete gamma by series and continued fraction, incomplete beta by Lentz's
continued fraction; quantiles by bisection. None (NaN) in, none out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _each(f):
    return np.vectorize(f, otypes=[float])


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if not (x > 0 and a > 0):
        return 0.0 if x == 0 else math.nan
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - h * scale


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta."""
    if math.isnan(x) or not (a > 0 and b > 0):
        return math.nan
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def norm_p2(z: float) -> float:
    """Two-sided p-value of a normal statistic."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_sf(x: float, k: float) -> float:
    return 1 - gamma_p(k / 2, x / 2) if k > 0 and x >= 0 else math.nan


def t_cdf(t: float, v: float) -> float:
    if math.isnan(t) or not v > 0:
        return math.nan
    tail = 0.5 * beta_i(v / 2, 0.5, v / (v + t * t))
    return 1 - tail if t > 0 else tail


def t_p2(t: float, v: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_i(v / 2, 0.5, v / (v + t * t)) if v > 0 and not math.isnan(t) else math.nan


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if d1 > 0 and d2 > 0 and f >= 0 else math.nan


def quantile(cdf, p: float, low: float, high: float) -> float:
    """The point at which an increasing ``cdf`` reaches ``p``, by bisection between ``low`` and ``high``."""
    if not 0 < p < 1:
        return math.nan
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def norm_ppf(p: float) -> float:
    return quantile(norm_cdf, p, -40, 40)


def t_ppf(p: float, v: float) -> float:
    return quantile(lambda t: t_cdf(t, v), p, -1e6, 1e6) if v > 0 else math.nan


def beta_ppf(p: float, a: float, b: float) -> float:
    return quantile(lambda x: beta_i(a, b, x), p, 0.0, 1.0) if a > 0 and b > 0 else math.nan


def power_two_sample(d: float, n: float, alpha: float = 0.05) -> float:
    """Power of a two-sample t test by a shifted t: 1 - T(t_crit - d sqrt(n / 2)), held within 0 and 1."""
    v = 2 * n - 2
    if not v > 0:
        return math.nan
    return min(1.0, max(0.0, 1 - t_cdf(t_ppf(1 - alpha / 2, v) - d * math.sqrt(n / 2), v)))


def arrow(f, arity: int):
    """``f`` of ``arity`` numbers as an Arrow function of columns."""
    g = _each(lambda *x: math.nan if any(math.isnan(v) for v in x) else f(*x))

    def of(*cols):
        out = pd.Series(g(*[c.astype(float).to_numpy() for c in cols]) if len(cols[0]) else [], dtype=float)
        return out.where(out.notna(), None)

    one = lambda a: of(a)
    two = lambda a, b: of(a, b)
    three = lambda a, b, c: of(a, b, c)
    typed = {1: one, 2: two, 3: three}[arity]
    typed.__annotations__ = {k: pd.Series for k in "abc"[:arity]} | {"return": pd.Series}
    return pandas_udf(typed, DoubleType())


norm_p2_col, chi2_sf_col, t_p2_col, f_sf_col = arrow(norm_p2, 1), arrow(chi2_sf, 2), arrow(t_p2, 2), arrow(f_sf, 3)
t_ppf_col, beta_ppf_col, norm_ppf_col, power_col = arrow(t_ppf, 2), arrow(beta_ppf, 3), arrow(norm_ppf, 1), arrow(power_two_sample, 2)
