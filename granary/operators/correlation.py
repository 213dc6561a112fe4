"""Correlations of prices with indices: guarded, split by phase, lagged, between columns."""

from __future__ import annotations

from itertools import combinations
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.functions.numeric import log_of, pair_count, safe_corr, zero_if_null
from granary.operators.panel import best_row, top_groups, with_keys
from granary.operators.series import Series, as_monthly, interpolate

#: Fewest rows for a correlation, and for one of its two phases.
MIN_ROWS, MIN_PHASE_ROWS = 20, 10

#: Labels of the unpivoted split correlations.
CONDITION_LABELS = {
    "corr_overall": "Overall", "corr_drought": "Drought (SPI<0)", "corr_flood": "Flood (SPI>0)",
}


def grouped_corr(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = MIN_ROWS) -> DataFrame:
    a, b = F.col(x), F.col(y)
    out = with_keys(df, keys).groupBy(*keys).agg(
        pair_count(a, b).alias("n"), safe_corr(a, b).alias("corr"))
    return out.filter(F.col("n") >= min_n)


def split_correlation(df: DataFrame, keys: Sequence[str], price: str, index: str,
                      min_n: int = MIN_ROWS, min_split_n: int = MIN_PHASE_ROWS) -> DataFrame:
    """Overall, drought-phase and flood-phase correlation in one aggregation.

    ``min_split_n=2`` leaves the phases unguarded.
    """
    p, i = F.col(price), F.col(index)
    dry, wet = i < 0, i > 0
    out = with_keys(df, keys).groupBy(*keys).agg(
        pair_count(p, i).alias("n_total"),
        pair_count(p, i, dry).alias("n_drought"),
        pair_count(p, i, wet).alias("n_flood"),
        safe_corr(p, i).alias("corr_overall"),
        safe_corr(p, i, dry, min_split_n).alias("corr_drought"),
        safe_corr(p, i, wet, min_split_n).alias("corr_flood"))
    return out.filter(F.col("n_total") >= min_n)


def best_scale(corrs: DataFrame, keys: Sequence[str], corr: str = "corr", scale: str = "scale",
               mode: str = "min") -> DataFrame:
    """Scale with the most negative (``min``) or strongest (``abs``) correlation."""
    score = F.col(corr) if mode == "min" else F.abs(F.col(corr))
    return best_row(corrs, keys, score, [scale], largest=mode != "min")


def best_phase_scales(corrs: DataFrame, keys: Sequence[str], scale: str = "scale") -> DataFrame:
    """Strongest scale for drought and for flood separately; a missing value counts as 0."""
    def strongest(col: str) -> Column:
        size = F.coalesce(F.abs(F.col(col)), F.lit(0.0))
        return F.min_by(F.struct(F.col(scale).alias("s"), F.col(col).alias("c")), F.struct(-size, scale))

    return corrs.groupBy(*keys).agg(
        strongest("corr_drought").alias("d"), strongest("corr_flood").alias("f")
    ).select(*keys, F.col("d.s").alias("best_drought_scale"), F.col("d.c").alias("drought_corr"),
             F.col("f.s").alias("best_flood_scale"), F.col("f.c").alias("flood_corr"))


def most_observed(corrs: DataFrame, n: int = 4, key: str = "commodity_group") -> DataFrame:
    """Correlations of the ``n`` groups with the most observations."""
    return corrs.join(top_groups(corrs, key, "n_total", n).select(key), [key], "left_semi")


def lagged_correlation(df: DataFrame, s: Series, target: str, feature: str, max_lag: int) -> DataFrame:
    """Correlation of the target with the feature 0..max_lag months earlier, per series.

    ``df`` is a monthly series without gaps in either column (see :func:`lag_series`). A series
    becomes one row of arrays as long as the calendar: values about their means, and running
    sums of them and of their squares, so that a lag's own sums are differences of two entries
    and only the products of the shifted arrays are added up per lag.
    """
    w, whole = s.window().rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*s.keys)
    y, x = (F.col(c) - F.avg(c).over(whole) for c in (target, feature))
    rows = df.select(*s.keys, s.time, y.alias("y"), x.alias("x")).select(
        *s.keys, F.struct(F.col(s.time).alias("t"), "y", "x", F.sum("y").over(w).alias("sy"), F.sum("x").over(w).alias("sx"),
                          F.sum(F.col("y") * F.col("y")).over(w).alias("syy"), F.sum(F.col("x") * F.col("x")).over(w).alias("sxx")).alias("m"))
    arrays = rows.groupBy(*s.keys).agg(F.array_sort(F.collect_list("m")).alias("m"))
    n = F.size("m")

    def at(k: Column) -> Column:
        size = n - k
        late, early = F.slice("m", k + 1, size), F.slice("m", 1, size)
        head = lambda c: F.when(k > 0, F.element_at("m", F.greatest(k, F.lit(1)))[c]).otherwise(0.0)
        sy, syy = (F.element_at("m", n)[c] - head(c) for c in ("sy", "syy"))
        sx, sxx = (F.element_at("m", size)[c] for c in ("sx", "sxx"))
        sxy = F.aggregate(F.zip_with(late, early, lambda a, b: a["y"] * b["x"]), F.lit(0.0), lambda total, v: total + v)
        varies = lambda part, c: F.array_min(F.transform(part, lambda v: v[c])) < F.array_max(F.transform(part, lambda v: v[c]))
        top = sxy - sx * sy / size
        r = F.try_divide(top, F.sqrt(F.greatest(syy - sy * sy / size, F.lit(0.0)) * F.greatest(sxx - sx * sx / size, F.lit(0.0))))
        return F.struct(k.alias("lag"), size.cast("long").alias("n"),
                        F.when((size >= 2) & varies(late, "y") & varies(early, "x"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("corr"))

    lags = F.sequence(F.lit(0), F.least(F.lit(max_lag), n - 1))
    return arrays.select(*s.keys, F.inline(F.transform(lags, at)))


def lag_series(df: DataFrame, s: Series, price: str, feature: str) -> DataFrame:
    """Monthly log price without gaps, beside the feature with 0 (its mean) where it is missing;
    months before the first price are left out."""
    filled = interpolate(as_monthly(df, s), s, price)
    out = filled.select(*s.keys, s.time, log_of(F.col(price)).alias(price), zero_if_null(F.col(feature)).alias(feature))
    return out.filter(F.col(price).isNotNull())


def strongest_lag(lags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag with the largest absolute correlation. Values equal to nine digits tie, and the
    shorter lag wins: two-row samples all correlate fully, give or take the last bit."""
    return best_row(lags, keys, F.round(F.abs(F.col("corr")), 9), ["lag"])


def corr_matrix(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each pair of columns as a row, over the rows where both are present; one pass."""
    pairs = F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), pair_count(F.col(a), F.col(b)).alias("n"),
                 safe_corr(F.col(a), F.col(b)).alias("corr"))
        for a, b in combinations(cols, 2)])
    return df.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.inline("_p"))


def corr_block(df: DataFrame, features: Sequence[str], targets: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Feature-against-target correlations as rows."""
    pairs = F.array(*[
        F.struct(F.lit(a).alias("feature"), F.lit(b).alias("target"), pair_count(F.col(a), F.col(b)).alias("n"),
                 safe_corr(F.col(a), F.col(b)).alias("corr"))
        for a in features for b in targets])
    return df.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.inline("_p"))


def top_correlations(block: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` strongest rows with the direction of the effect."""
    ranked = block.filter("corr IS NOT NULL").orderBy(F.abs(F.col("corr")).desc(), "feature", "target").limit(n)
    return ranked.withColumn("direction", F.when(F.col("corr") > 0, "up").otherwise("down"))
