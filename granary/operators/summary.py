"""Counts, describes, histograms, tests and error measures."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.functions.tails import t_pvalue
from granary.operators.lookup import lookup
from granary.operators.quantiles import exact_quantiles
from granary.operators.series import Series


def value_counts(df: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    """Rows and mean price per unit (or commodity x unit), most frequent first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(price).alias("mean_price")).orderBy(
        F.col("n").desc(), *keys)


def extent_by(df: DataFrame, keys: Sequence[str], date: str, distinct: Sequence[str]) -> DataFrame:
    """Row count, first and last date and distinct counts per group."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        *[F.count_distinct(c).alias(f"n_{c}") for c in distinct])


def describe_by(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum."""
    base = df.groupBy(*keys).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"))
    quartiles = exact_quantiles(df, keys, col, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return base.join(quartiles, list(keys), "left")


def early_versus_rest(df: DataFrame, s: Series, col: str, n_early: int = 16, alert_above: float = 0.5) -> DataFrame:
    """Means of the first rows and of the rest of each series, with an alert on a wide gap."""
    early = F.row_number().over(s.window()) <= n_early
    out = df.withColumn("_e", early).groupBy(*s.keys).agg(
        F.avg(F.when(F.col("_e"), F.col(col))).alias("mean_early"),
        F.avg(F.when(~F.col("_e"), F.col(col))).alias("mean_rest"))
    gap = F.col("mean_early") - F.col("mean_rest")
    return out.withColumns({"mean_diff": gap, "alert": F.abs(gap) > alert_above})


def period_describe(df: DataFrame, s: Series, col: str, n_early: int = 16) -> DataFrame:
    period = F.when(F.row_number().over(s.window()) <= n_early, "early").otherwise("rest")
    return describe_by(df.withColumn("period", period), [*s.keys, "period"], col)


def missing_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in cols])


def rows_missing_any(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    gap = F.col(cols[0]).isNull()
    for c in cols[1:]:
        gap = gap | F.col(c).isNull()
    return df.filter(gap)


def well_observed(df: DataFrame, keys: Sequence[str], col: str, min_n: int = 20) -> DataFrame:
    """Rows of the series with at least ``min_n`` values. The counts are aggregated first
    and joined back, so a hot series is not gathered."""
    ok = df.groupBy(*keys).agg(F.count(col).alias("_n")).filter(F.col("_n") >= min_n)
    return df.join(ok.select(*keys), list(keys), "left_semi")


def profile(df: DataFrame, stem: str = "food_prices", date: str = "date", country: str = "countryiso3") -> DataFrame:
    """Years, countries and rows of a data set, and a descriptive name made of them."""
    out = df.agg(
        F.min(F.year(date)).alias("first_year"), F.max(F.year(date)).alias("last_year"),
        F.count_distinct(country).alias("n_countries"), F.count(F.lit(1)).alias("n_records"))
    text = lambda c: F.col(c).cast("string")
    years = F.when(F.col("first_year") == F.col("last_year"), text("first_year")).otherwise(
        F.concat_ws("-", text("first_year"), text("last_year")))
    return out.withColumn("name", F.concat(
        F.lit(stem + "_"), years, F.lit("_"), text("n_countries"), F.lit("countries_"), text("n_records"), F.lit("records")))


def histogram(df: DataFrame, col: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal bins between minimum and maximum; the maximum belongs to the last bin."""
    span = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    if keys:
        spread = lookup(df, span, list(keys), "inner")
    else:
        limits = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
        spread = df.withColumn("_s", limits).withColumns({"_lo": F.col("_s.lo"), "_hi": F.col("_s.hi")})
    at = F.floor(F.try_divide((F.col(col) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    bin_ = F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")
    width = (F.col("_hi") - F.col("_lo")) / bins
    return spread.filter(F.col(col).isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("_lo") + bin_ * width).alias("bin_start"))


def mode_of(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value, the smallest on ties."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(col), F.col("n")), F.struct(-F.col("n"), F.col(col))).alias("m")
    ).select(*keys, F.col(f"m.{col}").alias(col), F.col("m.n").alias("n"))


def cell_month_means(df: DataFrame, keys: Sequence[str], value: str, counted: str, n_name: str) -> DataFrame:
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.avg(value).alias(value), F.count(counted).alias(n_name))


def drought_impact(df: DataFrame, flag: str, inflation: str, price: str) -> DataFrame:
    """Inflation and price level by drought flag."""
    some = df.filter(F.col(flag).isNotNull())
    base = some.groupBy(flag).agg(
        F.avg(inflation).alias("inflation_mean"), F.stddev_samp(inflation).alias("inflation_std"),
        F.count(inflation).alias("inflation_count"), F.avg(price).alias("price_mean"))
    return base.join(exact_quantiles(some, [flag], price, {"price_median": 0.5}), [flag], "left")


def two_sample_t(df: DataFrame, flag: str, value: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Pooled two-sample t-test of flag 1 against flag 0, from merged moments."""
    one, zero = (F.when(F.col(flag) == k, F.col(value)) for k in (1, 0))
    m = df.groupBy(*keys).agg(
        F.count(one).alias("n1"), F.count(zero).alias("n0"), F.avg(one).alias("mean1"), F.avg(zero).alias("mean0"),
        F.var_samp(one).alias("_v1"), F.var_samp(zero).alias("_v0"))
    dof = F.col("n1") + F.col("n0") - 2
    pooled = F.try_divide((F.col("n1") - 1) * F.col("_v1") + (F.col("n0") - 1) * F.col("_v0"), dof)
    se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n0"))))
    t = F.try_divide(F.col("mean1") - F.col("mean0"), se)
    return m.withColumn("t", t).withColumn("p", t_pvalue(F.col("t"), dof)).withColumn(
        "significant", F.col("p") < alpha).drop("_v1", "_v0")


def trend_line(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y on x per group."""
    return df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def plot_sample(df: DataFrame, bounds: dict[str, float], n: int, key: Sequence[str]) -> DataFrame:
    """Rows inside the absolute bounds, at most ``n`` of them, drawn by a hash of the key so
    that the draw repeats. A sampling operator: the limit is what is asked for."""
    inside = df
    for c, b in bounds.items():
        inside = inside.filter(F.abs(F.col(c)) < b)
    draw = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return inside.orderBy(draw, *key).limit(n)


def residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def fit_metrics(df: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """RMSE, MAE, R2 (one minus error over total variation) and Pearson r per group."""
    a, p = F.col(actual), F.col(predicted)
    both = df.filter(a.isNotNull() & p.isNotNull())
    sse, sst = F.sum((a - p) * (a - p)), F.regr_syy(a, a)
    r = F.when((F.min(a) < F.max(a)) & (F.min(p) < F.max(p)),
               F.try_divide(F.covar_pop(a, p), F.stddev_pop(a) * F.stddev_pop(p)))
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.avg(F.abs(a - p)).alias("mae"), (1 - F.try_divide(sse, sst)).alias("r2"), r.alias("pearson_r"))


def encode(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Alphabetical integer codes (missing: -1) and the mapping as a table.

    One pass finds the distinct values of all columns; they are ranked in one window by
    column, with as many rows as the column has categories.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in cols])
    values = df.select(F.inline(pairs)).filter("value IS NOT NULL").distinct()
    mapping = values.withColumn("code", F.row_number().over(W.partitionBy("variable").orderBy("value")) - 1)
    out = df
    for c in cols:
        codes = mapping.filter(F.col("variable") == c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        out = lookup(out, codes, [c]).withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return out, mapping
