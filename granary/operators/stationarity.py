"""Augmented Dickey-Fuller test with a constant, lag chosen by AIC, for many series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.tails import normal_cdf
from granary.operators.series import TASK, Series, spread

# MacKinnon (1994) approximation for a test with a constant.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def _dickey_fuller(x: np.ndarray) -> tuple[float, int, int] | None:
    """Test statistic, lag and sample size, or None for a series too short or too flat."""
    top = min(len(x) // 2 - 2, math.ceil(12 * (len(x) / 100) ** 0.25))
    if top < 0 or np.ptp(x) == 0:
        return None
    dx = np.diff(x)

    def design(lag: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(start, len(dx))
        return np.column_stack(
            [np.ones(len(rows)), x[rows], *[dx[rows - j] for j in range(1, lag + 1)]]), dx[rows]

    # Lags are compared on the sample the longest of them allows. The models are nested, so
    # one orthogonal basis yields the error sum of each.
    full, target = design(top, top)
    n = len(target)
    if n <= full.shape[1]:
        return None
    basis, upper = np.linalg.qr(full)
    if np.abs(np.diag(upper)).min() <= 1e-10 * np.abs(np.diag(upper)).max():
        return None
    sse = target @ target - np.cumsum((basis.T @ target) ** 2)[1:]
    if (sse <= 0).any():
        return None
    lag = int(np.argmin(n * np.log(sse / n) + 2 * (np.arange(top + 1) + 2)))

    best, target = design(lag, lag)
    n, k = best.shape
    inverse = np.linalg.inv(best.T @ best)
    coef = inverse @ (best.T @ target)
    err = target - best @ coef
    se = math.sqrt(float(err @ err) / (n - k) * inverse[1, 1])
    return (coef[1] / se, lag, n) if se > 0 else None


def stationarity(df: DataFrame, s: Series, col: str, level: float = 0.05) -> DataFrame:
    """``statistic, lag, n_used, p_value, stationary`` per series.

    One group is one monthly series without its missing values, so it is as short as the
    calendar; the series are spread over the cluster.
    """
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in s.keys)
    ordered = {f.name for f in df.schema if f.name in s.keys}
    names = [f.name for f in df.schema if f.name in ordered]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _dickey_fuller(pdf.sort_values(s.time)[col].to_numpy(float))
        stat, lag, n = got or (None, None, None)
        row = {**{k: [pdf[k].iloc[0]] for k in names}, "statistic": [stat], "lag": [lag], "n_used": [n]}
        return pd.DataFrame(row).astype({"statistic": float, "lag": "Int32", "n_used": "Int32"})

    rows = df.select(*names, s.time, col).filter(F.col(col).isNotNull())
    tested = spread(rows, names).groupBy(*names, TASK).applyInPandas(
        run, f"{key_types}, statistic double, lag int, n_used int")
    t = F.when(~F.isnan("statistic"), F.col("statistic"))
    z = sum((F.lit(c) * F.pow(t, i) for i, c in enumerate(SMALL_P)), F.lit(0.0))
    z_high = sum((F.lit(c) * F.pow(t, i) for i, c in enumerate(LARGE_P)), F.lit(0.0))
    p = F.when(t > TAU_MAX, 1.0).when(t < TAU_MIN, 0.0).otherwise(
        normal_cdf(F.when(t <= TAU_STAR, z).otherwise(z_high)))
    return tested.withColumn("statistic", t).withColumn("p_value", F.when(t.isNotNull(), p)).withColumn(
        "stationary", F.col("p_value") < level)
