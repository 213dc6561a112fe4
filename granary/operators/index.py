"""Standardised precipitation index from monthly grids."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.functions.numeric import index_class
from granary.functions.tails import gamma_index
from granary.operators.series import Series, accumulate

# Accumulation months that are generated and that are analysed, default
# calibration years, and the fewest data years a calibration may rest on.
GENERATED_SCALES = (1, 2, 3, 6, 9, 12)
ANALYSED_SCALES = (1, 3, 6, 12, 24)
CALIBRATION = (1991, 2020)
MIN_CALIBRATION_YEARS = 5


def clamp_calibration(calibration: tuple[int, int], data_years: tuple[int, int]) -> tuple[int, int]:
    """Calibration years cut to the data years; an error if those are fewer than five and the
    asked period does not lie inside them."""
    start, end = calibration
    first, last = data_years
    if start >= first and end <= last:
        return calibration
    if last - first + 1 < MIN_CALIBRATION_YEARS:
        raise ValueError(f"{first}-{last} is shorter than {MIN_CALIBRATION_YEARS} years")
    return max(start, first), min(end, last)


def fit_gamma(df: DataFrame, value: str, keys: Sequence[str], calibration: tuple[int, int] | None = None,
              time: str = "time") -> DataFrame:
    """Adds ``alpha, beta, zero_share`` of each (keys, calendar month) group.

    Thom's estimate from the mean and the mean log of the positive sums. The parameters are
    window aggregates over one row per year, which keep the layout of the accumulation
    window, so neither a shuffle nor a join back is needed.
    """
    w = W.partitionBy(*keys, F.month(time))
    x = F.col(value)
    if calibration is not None:
        x = F.when(F.year(time).between(*calibration), x)
    wet = F.when(x > 0, x)
    mean = F.avg(wet).over(w)
    spread = F.ln(mean) - F.avg(F.ln(wet)).over(w)
    alpha = F.when(spread > 1e-12, (1 + F.sqrt(1 + 4 * spread / 3)) / (4 * spread))
    zero = F.try_divide(F.count(F.when(x == 0, 1)).over(w), F.count(x).over(w))
    return df.withColumn("alpha", alpha).withColumn("zero_share", zero).withColumn(
        "beta", F.try_divide(mean, F.col("alpha")))


def accumulate_scales(df: DataFrame, value: str, scales: Sequence[int], keys: Sequence[str] = ("iy", "ix"),
                      time: str = "time") -> DataFrame:
    """``k``-month sums as rows ``(keys, time, scale, total)`` plus any further columns."""
    wide = accumulate(df, Series(tuple(keys), time), value, scales, "_sum")
    pairs = F.array(*[F.struct(F.lit(k).alias("scale"), F.col(f"_sum_{k}").alias("total")) for k in scales])
    kept = [c for c in df.columns if c != value]
    return wide.select(*kept, F.explode(pairs).alias("_p")).select(*kept, "_p.scale", "_p.total")


def spi(df: DataFrame, scales: Sequence[int] = ANALYSED_SCALES, value: str = "precip",
        keys: Sequence[str] = ("iy", "ix"), time: str = "time",
        calibration: tuple[int, int] | None = None) -> DataFrame:
    """The index per cell, month and scale: one shuffle, by cell.

    ``calibration`` limits the years the law is fitted on; by default the full history.
    The first ``k - 1`` months and groups without a usable fit are NULL.
    """
    totals = accumulate_scales(df, value, scales, keys, time)
    fitted = fit_gamma(totals, "total", [*keys, "scale"], calibration, time)
    # A total of zero needs no gamma law: its score is that of the zero share itself.
    return fitted.withColumn(
        "spi", gamma_index(F.col("total"), F.col("alpha"), F.col("beta"), F.col("zero_share")),
    ).drop("alpha", "beta", "zero_share", "total")


def spi_summary(df: DataFrame, spi_col: str = "spi", lat: str = "lat", lon: str = "lon", time: str = "time") -> DataFrame:
    """Bounds, period, moments and drought classes per scale."""
    kind = index_class(F.col(spi_col))
    out = df.groupBy("scale").agg(
        F.min(time).alias("first_month"), F.max(time).alias("last_month"),
        F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"),
        F.count(spi_col).alias("n_valid"), F.count_if(F.col(spi_col).isNull()).alias("n_missing"),
        F.avg(spi_col).alias("mean"), F.stddev_pop(spi_col).alias("std"),
        F.min(spi_col).alias("min"), F.max(spi_col).alias("max"),
        *[F.count_if(kind == f"{k} drought").alias(f"n_{k}") for k in ("extreme", "severe", "moderate")])
    return out.withColumns({
        f"pct_{k}": F.try_divide(100.0 * F.col(f"n_{k}"), F.col("n_valid")) for k in ("extreme", "severe", "moderate")})
