"""Least squares for many groups at once.

All fits of a job come out of one aggregation of means and co-moments (Spark's own merging
``covar_pop``, which is centred and therefore well conditioned), followed by a small
``k x k`` solve per group, vectorised over the groups of a batch.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from granary.functions.tails import f_pvalue, t_pvalue
from granary.operators.panel import with_keys
from granary.operators.series import Series

#: Fixed value: fewest rows for a regression.
MIN_ROWS = 20

_SOLUTION = StructType([
    StructField("coef", ArrayType(DoubleType())),
    StructField("inv_diag", ArrayType(DoubleType())),
    StructField("mean_form", DoubleType()),
])


@F.pandas_udf(_SOLUTION)
def _solve(sxx: pd.Series, sxy: pd.Series, means: pd.Series) -> pd.DataFrame:
    """Coefficients, diagonal of the inverse and ``m' inv m``; NULL where the rank is short."""
    k = len(sxy.iloc[0]) if len(sxy) else 0
    out = pd.DataFrame({"coef": [None] * len(sxy), "inv_diag": [None] * len(sxy), "mean_form": [None] * len(sxy)})
    if not k:
        return out
    a = np.stack([np.asarray(v, float).reshape(k, k) for v in sxx])
    b = np.stack([np.asarray(v, float) for v in sxy])
    m = np.stack([np.asarray(v, float) for v in means])
    scale = np.sqrt(np.einsum("nii->ni", a))
    usable = (scale > 0).all(axis=1) & np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
    scale = np.where(scale > 0, scale, 1.0)
    unit = np.where(usable[:, None, None], a / scale[:, :, None] / scale[:, None, :], np.eye(k))
    full = usable & (np.linalg.eigvalsh(unit)[:, 0] > 1e-11)
    unit[~full] = np.eye(k)
    inv = np.linalg.inv(unit) / scale[:, :, None] / scale[:, None, :]
    coef = np.einsum("nij,nj->ni", inv, np.where(full[:, None], b, 0.0))
    form = np.einsum("ni,nij,nj->n", m, inv, m)
    for i in np.flatnonzero(full):
        out.at[i, "coef"] = coef[i].tolist()
        out.at[i, "inv_diag"] = np.diag(inv[i]).tolist()
        out.at[i, "mean_form"] = float(form[i])
    return out


def _moments(v: Sequence[str]) -> list[Column]:
    """Row count, means and co-moment sums of the variables."""
    pairs = combinations_with_replacement(range(len(v)), 2)
    n = F.count(F.lit(1))
    return [n.alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(v)],
            *[(F.covar_pop(v[i], v[j]) * n).alias(f"s{i}_{j}") for i, j in pairs]]


def grouped_ols(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], fixed_effect: str | None = None,
                min_n: int = MIN_ROWS) -> DataFrame:
    """One row per group: ``y`` on ``xs`` with an intercept, or with one per ``fixed_effect``.

    Rows missing any variable are left out. Columns: ``n, df_resid, r2, adj_r2, sse, sst,
    sigma2, f, f_pvalue, llf, aic, bic`` and per regressor ``coef_, se_, t_, p_``; without a
    fixed effect also ``intercept`` and its error, with one ``n_effects``. The fixed-effect
    fit sums within-area moments (the slopes and residuals of the dummy regression); its
    ``r2`` refers to the total variation of ``y``.
    """
    v = [y, *xs]
    k = len(xs)
    by = [*keys, fixed_effect] if fixed_effect else list(keys)
    part = with_keys(df, [*by, *v]).groupBy(*by).agg(*_moments(v))
    if fixed_effect:
        cols = [c for c in part.columns if c.startswith("s") and "_" in c and c[1].isdigit()]
        grand = F.sum(F.col("n") * F.col("m0")) / F.sum("n")
        between = F.sum(F.col("n") * F.col("m0") * F.col("m0")) - F.sum("n") * grand * grand
        part = part.groupBy(*keys).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_effects"),
            *[F.sum(c).alias(c) for c in cols], (F.sum("s0_0") + between).alias("sst"),
            *[(F.sum(F.col("n") * F.col(f"m{i}")) / F.sum("n")).alias(f"m{i}") for i in range(k + 1)])
    else:
        part = part.withColumns({"n_effects": F.lit(1), "sst": F.col("s0_0")})
    part = part.filter(F.col("n") >= min_n)

    idx = range(1, k + 1)
    s = lambda i, j: F.col(f"s{min(i, j)}_{max(i, j)}")
    solved = part.withColumn("_z", _solve(
        F.array(*[s(i, j) for i in idx for j in idx]), F.array(*[s(0, i) for i in idx]),
        F.array(*[F.col(f"m{i}") for i in idx])))
    b = [F.col("_z.coef")[i] for i in range(k)]
    explained = sum((b[i] * s(0, i + 1) for i in range(k)), F.lit(0.0))
    n, g = F.col("n"), F.col("n_effects")
    # greatest() would skip the NULL of a fit that is short of rank and call it perfect.
    sse = F.when(explained.isNotNull(), F.greatest(s(0, 0) - explained, F.lit(0.0)))
    out = solved.withColumn("sse", sse).withColumn("df_resid", n - k - g)
    out = out.withColumn("sigma2", F.try_divide("sse", F.when(F.col("df_resid") > 0, F.col("df_resid"))))
    out = out.withColumn("r2", 1 - F.try_divide("sse", "sst"))
    df_model = k + g - 1
    f = F.try_divide(F.try_divide(F.col("sst") - F.col("sse"), df_model), F.col("sigma2"))
    llf = -n / 2 * (F.log(F.lit(2 * np.pi)) + F.log(F.try_divide(F.col("sse"), n)) + 1)
    out = out.withColumns({
        "adj_r2": 1 - (1 - F.col("r2")) * F.try_divide(n - 1, F.when(F.col("df_resid") > 0, F.col("df_resid"))),
        "f": f, "llf": llf})
    out = out.withColumns({
        "f_pvalue": f_pvalue(F.col("f"), df_model, F.col("df_resid")),
        "aic": -2 * F.col("llf") + 2 * (df_model + 1), "bic": -2 * F.col("llf") + F.log(n) * (df_model + 1)})
    per_x = {}
    for i, x in enumerate(xs):
        per_x[f"coef_{x}"] = b[i]
        per_x[f"se_{x}"] = F.sqrt(F.col("sigma2") * F.col("_z.inv_diag")[i])
    if not fixed_effect:
        per_x["intercept"] = F.col("m0") - sum((b[i] * F.col(f"m{i + 1}") for i in range(k)), F.lit(0.0))
        per_x["se_intercept"] = F.sqrt(F.col("sigma2") * (1 / n + F.col("_z.mean_form")))
    out = out.withColumns(per_x)
    terms = [*xs, *([] if fixed_effect else ["intercept"])]
    value = lambda x: F.col(x if x == "intercept" else f"coef_{x}")
    out = out.withColumns({f"t_{x}": F.try_divide(value(x), F.col(f"se_{x}")) for x in terms})
    out = out.withColumns({f"p_{x}": t_pvalue(F.col(f"t_{x}"), F.col("df_resid")) for x in terms})
    first = ["n", "n_effects", "df_resid", "r2", "adj_r2", "sse", "sst", "sigma2", "f", "f_pvalue", "llf", "aic", "bic"]
    rest = [f"{a}{x}" for x in terms for a in (("" if x == "intercept" else "coef_"), "se_", "t_", "p_")]
    return out.select(*keys, *first, *rest)


def coefficient_rows(fit: DataFrame, keys: Sequence[str], xs: Sequence[str], intercept: bool = True) -> DataFrame:
    """The fit in long form: one row per term."""
    terms = [*xs, *(["intercept"] if intercept else [])]
    rows = F.array(*[
        F.struct(F.lit(x).alias("term"), F.col(x if x == "intercept" else f"coef_{x}").alias("coef"),
                 F.col(f"se_{x}").alias("se"), F.col(f"t_{x}").alias("t"), F.col(f"p_{x}").alias("p"))
        for x in terms])
    return fit.select(*keys, F.inline(rows))


def effect_levels(df: DataFrame, fit: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str],
                  fixed_effect: str) -> DataFrame:
    """Intercept of every area and its difference to the alphabetically first one."""
    by = [*keys, fixed_effect]
    means = with_keys(df, by).dropna(subset=[y, *xs]).groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in (y, *xs)])
    level = F.col(f"_m_{y}") - sum((F.col(f"coef_{x}") * F.col(f"_m_{x}") for x in xs), F.lit(0.0))
    levels = means.join(fit.select(*keys, *[f"coef_{x}" for x in xs]), list(keys)).select(*by, level.alias("level"))
    base = levels.groupBy(*keys).agg(F.min_by("level", fixed_effect).alias("_base"))
    return levels.join(base, list(keys)).select(*by, "level", (F.col("level") - F.col("_base")).alias("versus_base"))


def fitted_residuals(df: DataFrame, fit: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Rows of the fitted sample with prediction and residual; the fit joins back by key."""
    coefs = fit.select(*keys, "intercept", *[f"coef_{x}" for x in xs])
    guess = sum((F.col(f"coef_{x}") * F.col(x) for x in xs), F.col("intercept"))
    return df.dropna(subset=[y, *xs]).join(coefs, list(keys)).withColumn("fitted", guess).withColumn(
        "residual", F.col(y) - F.col("fitted")).drop("intercept", *[f"coef_{x}" for x in xs])


def residual_diagnostics(res: DataFrame, s: Series) -> DataFrame:
    """Durbin-Watson, skewness, kurtosis (3 for a normal law), Jarque-Bera and its p-value.

    Series are monthly, so the window for the residual before is short.
    """
    step = F.col("residual") - F.lag("residual").over(s.window())
    n = F.col("n")
    out = res.withColumn("_step", step).groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum(F.col("_step") * F.col("_step")), F.sum(F.col("residual") * F.col("residual"))).alias("durbin_watson"),
        F.skewness("residual").alias("skew"), (F.kurtosis("residual") + 3).alias("kurtosis"))
    jb = n / 6 * (F.col("skew") * F.col("skew") + (F.col("kurtosis") - 3) * (F.col("kurtosis") - 3) / 4)
    return out.withColumn("jarque_bera", jb).withColumn("p_jarque_bera", F.exp(-F.col("jarque_bera") / 2))


def compare_models(df: DataFrame, keys: Sequence[str], y: str, models: dict[str, Sequence[str]],
                   min_n: int = MIN_ROWS) -> DataFrame:
    """R2 and AIC of several regressor sets on one and the same sample."""
    every = sorted({x for xs in models.values() for x in xs})
    sample = df.dropna(subset=[y, *every])
    out = None
    for name, xs in models.items():
        fit = grouped_ols(sample, keys, y, xs, min_n=min_n).select(F.lit(name).alias("model"), *keys, "n", "r2", "aic")
        out = fit if out is None else out.unionByName(fit)
    return out
