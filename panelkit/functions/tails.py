"""Distribution tails for p-values (normal, chi-square, F, Student t).

Spark 4.1 has no erf/gamma functions, so these run as vectorised pandas UDFs
(numpy + ``math`` special functions: regularised incomplete gamma and beta by
series / continued fraction). They are applied to result tables (one row per
test), never to data-size tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15
_TINY = 1e-300


def _gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x < 0 or a <= 0 or math.isnan(x) or math.isnan(a):
        return float("nan")
    if x == 0:
        return 1.0
    lg = math.lgamma(a)
    if x < a + 1:  # series for P
        term = 1.0 / a
        total = term
        ap = a
        for _ in range(10_000):
            ap += 1
            term *= x / ap
            total += term
            if abs(term) < abs(total) * _EPS:
                break
        p = total * math.exp(-x + a * math.log(x) - lg)
        return max(0.0, 1.0 - p)
    # continued fraction for Q (modified Lentz)
    b = x + 1 - a
    c = 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - lg) * h


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1, a - 1
    c, d = 1.0, 1 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1 / d
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if math.isnan(x) or math.isnan(a) or math.isnan(b) or a <= 0 or b <= 0:
        return float("nan")
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def normal_two_sided(z: float) -> float:
    return float("nan") if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2))


def normal_upper(z: float) -> float:
    return float("nan") if z is None or math.isnan(z) else 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse standard normal CDF (Acklam's rational approximation + one Newton step)."""
    if p <= 0 or p >= 1:
        return float("nan")
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
         -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
         -1.328068155288572e01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00,
         4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
    lo = 0.02425
    if p < lo:
        q = math.sqrt(-2 * math.log(p))
        x = (((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
            ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    elif p <= 1 - lo:
        q = p - 0.5
        r = q * q
        x = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * q / \
            (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    else:
        q = math.sqrt(-2 * math.log(1 - p))
        x = -(((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) / \
            ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1)
    e = 0.5 * math.erfc(-x / math.sqrt(2)) - p
    u = e * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
    return x - u / (1 + x * u / 2)


def chi2_upper(x: float, k: float) -> float:
    if x is None or k is None or math.isnan(x) or math.isnan(k):
        return float("nan")
    if x <= 0:
        return 1.0
    return _gammainc_upper(k / 2.0, x / 2.0)


def f_upper(f: float, d1: float, d2: float) -> float:
    if any(v is None or math.isnan(v) for v in (f, d1, d2)) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def ncf_cdf(f: float, d1: float, d2: float, ncp: float) -> float:
    """Noncentral F CDF as a Poisson(ncp/2) mixture of incomplete betas.

    Only the window of 12 standard deviations around ncp/2 has weight. Weights
    and betas come from their ratio recurrences in numpy: I_x(a + j, b) is
    I_x(a + j + 1, b) plus a positive term, so one incomplete beta at the top of
    the window gives all others."""
    if f <= 0:
        return 0.0
    x = d1 * f / (d1 * f + d2)
    a, b = d1 / 2.0, d2 / 2.0
    if ncp <= 0:
        return betainc(a, b, x)
    half = ncp / 2.0
    sd = math.sqrt(half)
    lo, hi = max(0, int(half - 12 * sd - 30)), int(half + 12 * sd + 60)
    j = np.arange(lo, hi + 1, dtype=float)
    first = lo * math.log(half) - half - math.lgamma(lo + 1.0)
    weight = np.exp(first + np.concatenate(([0.0], np.cumsum(math.log(half) - np.log(j[1:])))))
    at = a + lo
    first = (at * math.log(x) + b * math.log1p(-x) + math.lgamma(at + b) - math.lgamma(at + 1.0) - math.lgamma(b)
             if 0 < x < 1 else -math.inf)
    steps = math.log(x) + np.log((a + j[:-1] + b) / (a + j[:-1] + 1.0))
    term = np.exp(first + np.concatenate(([0.0], np.cumsum(steps))))
    above = np.concatenate((np.cumsum(term[:-1][::-1])[::-1], [0.0]))
    beta = betainc(a + hi, b, x) + above
    return float(min(1.0, weight @ np.minimum(beta, 1.0)))


def eta2_partial_ci(f: float, d1: float, d2: float, level: float = 0.95) -> tuple[float, float]:
    """Two-sided CI of partial eta squared by inverting the noncentral F in its
    noncentrality ``ncp`` (monotone decreasing CDF), mapped by
    ``ncp / (ncp + d1 + d2 + 1)``; a bound whose tail is already exceeded at
    ncp = 0 is 0."""
    if any(v is None or math.isnan(v) for v in (f, d1, d2)) or d2 <= 0:
        return float("nan"), float("nan")
    a = (1 - level) / 2

    def solve(target):
        if ncf_cdf(f, d1, d2, 0.0) < target:
            return 0.0
        lo, hi = 0.0, max(10.0, f * d1 * 4 + 50)
        while ncf_cdf(f, d1, d2, hi) > target:
            hi *= 2
        while hi - lo > 1e-10 * hi + 1e-12:
            mid = (lo + hi) / 2
            if ncf_cdf(f, d1, d2, mid) > target:
                lo = mid
            else:
                hi = mid
        return (lo + hi) / 2

    lam_lo, lam_hi = solve(1 - a), solve(a)
    to_eta = lambda lam: lam / (lam + d1 + d2 + 1)
    return to_eta(lam_lo), to_eta(lam_hi)


def t_quantile(p: float, df: float) -> float:
    """Upper-tail quantile: t with P(T > t) = 1 - p, by bisection on the CDF."""
    if p is None or df is None or math.isnan(p) or math.isnan(df) or not 0 < p < 1 or df <= 0:
        return float("nan")
    if p == 0.5:
        return 0.0
    target = 2 * (1 - p) if p > 0.5 else 2 * p  # two-sided tail mass
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > target:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_two_sided(mid, df) > target:
            lo = mid
        else:
            hi = mid
    x = (lo + hi) / 2
    return x if p > 0.5 else -x


def poisson_quantile(u: float, lam: float) -> float:
    """Smallest k with P(X <= k) >= u for X ~ Poisson(lam) (exact CDF through
    the regularised upper incomplete gamma, bisection on k)."""
    if lam is None or u is None or math.isnan(lam) or math.isnan(u):
        return float("nan")
    if lam <= 0:
        return 0.0
    cdf = lambda k: _gammainc_upper(k + 1.0, lam)  # noqa: E731  P(X <= k)
    lo, hi = -1, int(lam + 12 * math.sqrt(lam) + 30)
    while cdf(hi) < u:
        hi *= 2
    while hi - lo > 1:  # invariant: cdf(lo) < u <= cdf(hi)
        mid = (lo + hi) // 2
        if cdf(mid) >= u:
            hi = mid
        else:
            lo = mid
    return float(hi)


def _vec(fn, *series):
    vals = [s.astype("float64").to_numpy() for s in series]
    out = np.array([fn(*[float(v[i]) for v in vals]) for i in range(len(vals[0]))], dtype="float64")
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def _normal2_udf(z: pd.Series) -> pd.Series:
    return _vec(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def _chi2_udf(x: pd.Series, k: pd.Series) -> pd.Series:
    return _vec(chi2_upper, x, k)


@F.pandas_udf(DoubleType())
def _f_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vec(f_upper, f, d1, d2)


@F.pandas_udf(DoubleType())
def _t2_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def _tq_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(t_quantile, p, df)


def poisson_quantiles(u: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Vectorised :func:`poisson_quantile`: one CDF table per distinct lam
    (pmf by a log-space recurrence over mode +- 12 sd), then ``searchsorted``."""
    out = np.full(len(u), np.nan)
    for lv in np.unique(lam[~np.isnan(lam)]):
        idx = np.where(lam == lv)[0]
        if lv <= 0:
            out[idx] = 0.0
            continue
        sd = math.sqrt(lv)
        lo = max(0, int(lv - 12 * sd - 10))
        hi = int(lv + 12 * sd + 30)
        k = np.arange(lo, hi + 1, dtype=float)
        logp0 = lo * math.log(lv) - lv - math.lgamma(lo + 1)
        steps = np.concatenate([[0.0], math.log(lv) - np.log(k[1:])])
        pmf = np.exp(logp0 + np.cumsum(steps))
        below = _gammainc_upper(float(lo), lv) if lo > 0 else 0.0  # P(X <= lo - 1)
        cdf = below + np.cumsum(pmf)
        pos = np.searchsorted(cdf, u[idx], side="left")
        out[idx] = k[np.minimum(pos, len(k) - 1)]
    return out


@F.pandas_udf(DoubleType())
def _pq_udf(u: pd.Series, lam: pd.Series) -> pd.Series:
    return pd.Series(poisson_quantiles(u.astype("float64").to_numpy(), lam.astype("float64").to_numpy()))


def q_poisson(u: Column, lam: Column) -> Column:
    """Poisson(lam) draw by inversion of the uniform ``u``."""
    return _pq_udf(u.cast("double"), lam.cast("double"))


def q_t(p: Column, df: Column) -> Column:
    """Student-t quantile (e.g. ``q_t(lit(0.975), df)`` for a 95 % band)."""
    return _tq_udf(p.cast("double"), df.cast("double"))


def p_normal_two_sided(z: Column) -> Column:
    return _normal2_udf(z.cast("double"))


def p_chi2(x: Column, k: Column) -> Column:
    return _chi2_udf(x.cast("double"), k.cast("double"))


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _f_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))


def p_t_two_sided(t: Column, df: Column) -> Column:
    return _t2_udf(t.cast("double"), df.cast("double"))
