"""Tail probabilities and the index transform, as vectorised UDFs over Arrow batches.

Spark has no incomplete gamma or beta function, so these few are written with numpy. Each
works on whole columns and keeps no state between batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed value: the index is cut off at this many standard deviations on both sides.
INDEX_LIMIT = 3.09

# Coefficients of the normal quantile, algorithm AS 241 (Wichura 1988).
AS241_A = (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
           1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
           3.3430575583588128105e4, 2.5090809287301226727e3)
AS241_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
           2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
           5.2264952788528545610e3)
AS241_C = (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
           3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
           2.27238449892691845833e-2, 7.74545014278341407640e-4)
AS241_D = (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
           1.05075007164441684324e-9)
AS241_E = (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
           2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
           2.71155556874348757815e-5, 2.01033439929228813265e-7)
AS241_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
           2.04426310338993978564e-15)

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_quantile(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, float)
    ratio = lambda num, den, r: np.polyval(num[::-1], r) / np.polyval(den[::-1], r)
    with np.errstate(all="ignore"):
        q = p - 0.5
        centre = q * ratio(AS241_A, AS241_B, 0.180625 - q * q)
        r = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
        tail = np.where(r <= 5.0, ratio(AS241_C, AS241_D, r - 1.6), ratio(AS241_E, AS241_F, r - 5.0))
        z = np.where(np.abs(q) <= 0.425, centre, np.sign(q) * tail)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, z))


#: Shape from which the gamma law, and degrees of freedom from which the t law, take their expansions.
LARGE_SHAPE, LARGE_DF = 1e4, 1e6
#: Rounds after which a series or fraction counts as not convergent and gives no value.
MOST_ROUNDS = 100_000


def _gamma_cdf_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """First term of Temme's uniform expansion; its error is below 1e-9 for shapes over 10,000."""
    mu = x / a - 1.0
    # mu - log(1 + mu) cancels near 0, where its power series is used.
    series = mu * mu * np.polyval([1 / 8, -1 / 7, 1 / 6, -1 / 5, 1 / 4, -1 / 3, 1 / 2], mu)
    half = np.where(np.abs(mu) < 1e-2, series, mu - np.log1p(mu))
    eta = np.sign(mu) * np.sqrt(2.0 * half)
    near = np.abs(eta) < 1e-3
    c0 = np.where(near, np.polyval([-2 / 135, 1 / 12, -1 / 3], eta),
                  1.0 / np.where(near, 1.0, mu) - 1.0 / np.where(near, 1.0, eta))
    return 0.5 * _erfc(-eta * np.sqrt(a / 2.0)) - c0 * np.exp(-a * half) / np.sqrt(2.0 * np.pi * a)


def gamma_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma: series left of the mode, continued fraction right, and
    a uniform expansion for large shapes. NaN where no value was reached."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    usable = (a > 0) & (x >= 0) & np.isfinite(a) & np.isfinite(x)
    out[usable & (x == 0)] = 0.0
    usable &= x > 0
    large = usable & (a > LARGE_SHAPE)
    if large.any():
        out[large] = _gamma_cdf_large(a[large], x[large])
    usable &= ~large
    low, high = usable & (x < a + 1), usable & (x >= a + 1)
    front = lambda m: np.exp(a[m] * np.log(x[m]) - x[m] - _lgamma(a[m]))
    if low.any():
        al, xl = a[low], x[low]
        term = total = 1.0 / al
        step = al.copy()
        for _ in range(MOST_ROUNDS):
            step = step + 1.0
            term = term * xl / step
            total = total + term
            done = term <= total * 1e-16
            if done.all():
                break
        out[low] = np.where(done, np.minimum(1.0, front(low) * total), np.nan)
    if high.any():
        ah, xh, tiny = a[high], x[high], 1e-300
        b = xh + 1.0 - ah
        c = np.full_like(b, 1.0 / tiny)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, MOST_ROUNDS + 1):
            an = -i * (i - ah)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            done = np.abs(d * c - 1.0) < 1e-13
            if (np.abs(d * c - 1.0) < 1e-15).all():
                break
        out[high] = np.where(done, np.maximum(0.0, 1.0 - front(high) * h), np.nan)
    return out


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction; NaN where it did not converge."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    flip = x > (a + 1.0) / (a + b + 2.0)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) - np.log(a)
                       - (_lgamma(a) + _lgamma(b) - _lgamma(a + b)))
        c, d = np.ones_like(x), 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
        h = d.copy()
        for m in range(1, MOST_ROUNDS + 1):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d = 1.0 / guard(1.0 + even * d)
            c = guard(1.0 + even / c)
            h = h * d * c
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1.0 / guard(1.0 + odd * d)
            c = guard(1.0 + odd / c)
            h = h * d * c
            if (~(np.abs(d * c - 1.0) > 1e-15)).all():
                break
        value = np.where(x <= 0, 0.0, np.where(np.abs(d * c - 1.0) < 1e-13, front * h, np.nan))
    return np.where(flip, 1.0 - value, value)



@F.pandas_udf(DoubleType())
def _gamma_index(x: pd.Series, alpha: pd.Series, beta: pd.Series, zero_share: pd.Series) -> pd.Series:
    xs, al, be, q = (s.to_numpy(float, na_value=np.nan) for s in (x, alpha, beta, zero_share))
    with np.errstate(all="ignore"):
        p = q + (1.0 - q) * gamma_cdf(al, xs / be)
        return pd.Series(np.clip(normal_quantile(p), -INDEX_LIMIT, INDEX_LIMIT))


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    tv, dv = (s.to_numpy(float, na_value=np.nan) for s in (t, df))
    with np.errstate(all="ignore"):
        exact = beta_cdf(dv / (dv + tv * tv), np.minimum(dv, LARGE_DF) / 2.0, np.full_like(dv, 0.5))
        # With many degrees of freedom a scaled statistic is normal, up to terms in 1 / df^2.
        z = tv * (1.0 - 0.25 / dv) / np.sqrt(1.0 + 0.5 * tv * tv / dv)
        return pd.Series(np.where(dv > LARGE_DF, _erfc(np.abs(z) / math.sqrt(2.0)), exact))


@F.pandas_udf(DoubleType())
def _f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    fv, a, b = (s.to_numpy(float, na_value=np.nan) for s in (f, d1, d2))
    with np.errstate(all="ignore"):
        return pd.Series(beta_cdf(b / (b + a * fv), b / 2.0, a / 2.0))


@F.pandas_udf(DoubleType())
def _normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(0.5 * _erfc(-z.to_numpy(float, na_value=np.nan) / math.sqrt(2.0)))


def _where(ok: Column, value: Column) -> Column:
    return F.when(ok, F.when(~F.isnan(value), value))


def gamma_index(x: Column, alpha: Column, beta: Column, zero_share: Column) -> Column:
    """Standard normal score of ``x`` under a gamma law with a point mass at zero."""
    ok = x.isNotNull() & alpha.isNotNull() & beta.isNotNull()
    return _where(ok, _gamma_index(x, alpha, beta, zero_share))


def t_pvalue(t: Column, df: Column) -> Column:
    return _where(t.isNotNull() & (df > 0), _t_two_sided(t.cast("double"), df.cast("double")))


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    return _where(f.isNotNull() & (d1 > 0) & (d2 > 0),
                  _f_upper(f.cast("double"), d1.cast("double"), d2.cast("double")))


def normal_cdf(z: Column) -> Column:
    return _where(z.isNotNull(), _normal_cdf(z.cast("double")))
