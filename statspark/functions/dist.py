"""Tail probabilities for summary rows.

Numpy kernels of series and continued fractions, wrapped as Arrow pandas UDFs.
They run on a handful of aggregated rows, never on raw data; ``norm_cdf``, which
does, is a column expression.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
#: Rows up to which the Kolmogorov tail is summed term by term.
KS_SUM = 100_000
_TINY = 1e-300
_EPS = 1e-15


def upper_gamma(a, x):
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    out[(x <= 0) & (a > 0)] = 1.0
    ok = (x > 0) & (a > 0) & np.isfinite(x)
    out[np.isposinf(x) & (a > 0)] = 0.0
    low, high = ok & (x < a + 1), ok & (x >= a + 1)
    if low.any():
        aa, xx = a[low], x[low]
        term = total = 1.0 / aa
        n = aa.copy()
        for _ in range(100_000):
            n = n + 1
            term = term * xx / n
            total = total + term
            if np.all(np.abs(term) < np.abs(total) * _EPS):
                break
        out[low] = 1.0 - total * np.exp(aa * np.log(xx) - xx - _lgamma(aa))
    if high.any():
        aa, xx = a[high], x[high]
        b = xx + 1 - aa
        c = np.full(aa.shape, 1 / _TINY)
        d = 1 / b
        h = d.copy()
        for i in range(1, 100_000):
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1) < _EPS * 10):
                break
        out[high] = h * np.exp(aa * np.log(xx) - xx - _lgamma(aa))
    return out


def _beta_fraction(a, b, x):
    """1 / (1 + d1 / (1 + d2 / (1 + …))), the fraction of the incomplete beta, from its far end."""
    depth = 100 + int(6 * math.sqrt(float(np.max(np.maximum(a, b)))))
    tail = np.ones_like(x)
    for m in range(depth, -1, -1):
        if m < depth:
            k = m + 1
            tail = 1 + k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) / tail
        tail = 1 - (a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) / tail
    return 1 / tail


def beta_cdf(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.full(a.shape, np.nan)
    valid = (a > 0) & (b > 0)
    out[valid & (x <= 0)] = 0.0
    out[valid & (x >= 1)] = 1.0
    ok = valid & (x > 0) & (x < 1)
    left = ok & (x < (a + 1) / (a + b + 2))
    for mask, flip in ((left, False), (ok & ~left, True)):
        if not mask.any():
            continue
        aa, bb, xx = a[mask], b[mask], x[mask]
        front = np.exp(
            _lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)
        )
        if flip:
            out[mask] = 1 - front * _beta_fraction(bb, aa, 1 - xx) / bb
        else:
            out[mask] = front * _beta_fraction(aa, bb, xx) / aa
    return out


def chi2_tail(x, dof):
    x, dof = np.asarray(x, float), np.asarray(dof, float)
    p = upper_gamma(np.where(dof > 0, dof, 1) / 2, x / 2)
    return np.where(dof > 0, p, np.where(np.isnan(x), np.nan, 1.0))


def f_tail(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(np.isposinf(f), 0.0, d2 / (d2 + d1 * f))
    return np.where(np.isnan(f), np.nan, beta_cdf(d2 / 2, d1 / 2, x))


def t_two_sided(t, dof):
    t = np.asarray(t, float)
    return f_tail(t * t, np.ones_like(t), dof)


def norm_two_sided(z):
    z = np.asarray(z, float)
    return np.where(np.isnan(z), np.nan, _erfc(np.abs(np.nan_to_num(z)) / math.sqrt(2)))


def norm_cdf_array(z):
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2))


def norm_ppf_array(p):
    inv = NormalDist().inv_cdf
    return np.array([inv(v) if 0 < v < 1 else np.nan for v in np.asarray(p, float)], float)


def fisher_two_sided(a, b, c, d) -> float:
    """Two-sided exact p of a 2x2 table: mass of all tables no likelier than the seen one."""
    a, b, c, d = (int(v) for v in (a, b, c, d))
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2
    if min(r1, r2, c1, b + d) == 0:
        return 1.0
    lo, hi = max(0, c1 - r2), min(r1, c1)

    def log_choose(top, k):
        return math.lgamma(top + 1) - _lgamma(k + 1) - _lgamma(top - k + 1)

    k = np.arange(lo, hi + 1, dtype=float)
    logp = log_choose(r1, k) + log_choose(r2, c1 - k)
    base = math.lgamma(n + 1) - math.lgamma(c1 + 1) - math.lgamma(n - c1 + 1)
    p = np.exp(logp - base)
    seen = p[a - lo]
    return float(min(1.0, p[p <= seen * (1 + 1e-7)].sum()))


def ks_two_sided(d: float, n: int) -> float:
    """P(D_n >= d): twice the one-sided law in the tail, exact matrix or series elsewhere.

    The one-sided law is its finite sum up to ``KS_SUM`` rows, and its expansion in 1/n above.
    """
    if not (d > 0):
        return 1.0
    if d >= 1:
        return 0.0
    if n * d * d > 2.2:
        if n > KS_SUM:
            z = (6 * n * d + 1) ** 2 / (18 * n)
            return float(min(1.0, 2 * math.exp(-z) * max(0.0, 1 - (2 * z * z - 4 * z - 1) / (18 * n))))
        j = np.arange(0, math.floor(n * (1 - d)) + 1, dtype=float)
        base = np.maximum(1 - d - j / n, _TINY)
        logs = (
            math.lgamma(n + 1) - _lgamma(j + 1) - _lgamma(n - j + 1)
            + (j - 1) * np.log(d + j / n) + (n - j) * np.log(base)
        )
        return float(min(1.0, 2 * d * np.exp(logs).sum()))
    if n * d < 60:
        return float(min(1.0, max(0.0, 1 - _ks_matrix(d, n))))
    root = math.sqrt(n)
    x = root * d + 1 / (6 * root) + (root * d - 1) / (4 * n)
    k = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)))))


def _ks_matrix(d: float, n: int) -> float:
    k = math.floor(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    i = np.arange(m)
    mat = (i[:, None] - i[None, :] + 1 >= 0).astype(float)
    mat[:, 0] -= h ** (i + 1)
    mat[m - 1, :] -= h ** (m - i)
    mat[m - 1, 0] += max(0.0, 2 * h - 1) ** m
    gap = i[:, None] - i[None, :] + 1
    scale = np.exp(_lgamma(np.maximum(gap, 0) + 1.0))
    mat = np.where(gap > 0, mat / scale, mat)
    power, log_scale, result, left = mat, 0.0, np.eye(m), n
    log_power = 0.0
    while left:
        if left & 1:
            result, log_scale = result @ power, log_scale + log_power
            top = np.abs(result).max()
            result, log_scale = result / top, log_scale + math.log(top)
        power, log_power = power @ power, 2 * log_power
        top = np.abs(power).max()
        power, log_power = power / top, log_power + math.log(top)
        left >>= 1
    value = result[k - 1, k - 1]
    if value <= 0:
        return 0.0
    return math.exp(math.log(value) + log_scale + math.lgamma(n + 1) - n * math.log(n))


def shapiro_wilk(values) -> tuple[float, float]:
    """Shapiro-Wilk W and p by Royston's 1995 approximation (algorithm AS R94), n <= 5000."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[-1] - x[0] < 1e-19:
        return (float("nan"), float("nan")) if n < 3 else (1.0, 1.0)
    m = norm_ppf_array((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    ssm = float(m @ m)
    u = 1 / math.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[2] = math.sqrt(0.5)
        a[0] = -a[2]
    else:
        # Royston's polynomial coefficients for the two outer weights.
        outer = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(ssm)], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(ssm)], u)
            phi = (ssm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * outer**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            phi = (ssm - 2 * m[-1] ** 2) / (1 - 2 * outer**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[-1], a[0] = outer, -outer
    dev = x - x.mean()
    w = min(1.0, float((a @ x) ** 2 / (dev @ dev)))
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, p)
    y = math.log(max(1 - w, 1e-300))
    # Royston's normalising polynomials.
    if n <= 11:
        gamma = np.polyval([0.459, -2.273], n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2))


def _series(values) -> pd.Series:
    return pd.Series(values).where(~pd.isna(values), None).astype("float64")


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _series(chi2_tail(x.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _series(f_tail(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def t_sf2(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _series(t_two_sided(t.to_numpy(float), dof.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def norm_sf2(z: pd.Series) -> pd.Series:
    return _series(norm_two_sided(z.to_numpy(float)))


def norm_cdf(z: Column) -> Column:
    """Normal distribution function as a column expression, for use on raw rows."""
    # Hart's double-precision rational approximation of the upper tail, highest power first.
    above = [
        3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
        221.213596169931, 220.206867912376,
    ]
    below = [
        8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
        637.333633378831, 793.826512519948, 440.413735824752,
    ]
    x = F.abs(z)

    def polynomial(coefficients):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    far = x
    for k in (4, 3, 2, 1):  # Mills' ratio as a continued fraction
        far = x + k / (far + 0.65 if k == 4 else far)
    bell = F.exp(-x * x / 2)
    tail = F.when(x < 7.07, bell * polynomial(above) / polynomial(below)).otherwise(bell / far / math.sqrt(2 * math.pi))
    return F.when(z.isNull() | F.isnan(z), None).when(z > 0, 1 - tail).otherwise(tail)


@F.pandas_udf(T.DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return _series(norm_ppf_array(p.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*row) for row in zip(a, b, c, d)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def ks_sf(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([ks_two_sided(float(x), int(k)) for x, k in zip(d, n)], dtype="float64")
