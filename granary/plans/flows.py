"""End-to-end pipelines made of the operators: prices, indices, panels, reports."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import names
from granary.functions.dates import month_start
from granary.functions.numeric import above, below, log_of, safe_corr
from granary.operators import correlation, index, panel, regression, series, spatial
from granary.operators.forecast import prepare
from granary.operators.series import Series
from granary.sources.tables import kept

PANEL_KEYS = ["countryiso3", "month", "commodity_group"]


def monthly_prices(prices: DataFrame, targets: Sequence[str] = names.STAPLES_AND_TEFF) -> DataFrame:
    """Mean price per kg by country, month and commodity family."""
    rows = panel.without(panel.only_commodities(prices, targets), names.NOT_FOOD)
    rows = panel.price_per_kg(panel.only_groups(series.with_month(rows), targets))
    return panel.mean_by(rows, PANEL_KEYS, "price_per_kg")


def monthly_usd_prices(prices: DataFrame, targets: Sequence[str] = names.STAPLES) -> DataFrame:
    """Mean price of whatever unit is sold, as the pooled regression uses it."""
    rows = panel.only_groups(panel.only_commodities(series.with_month(prices), targets), targets)
    return panel.mean_by(rows, PANEL_KEYS, "usdprice")


def national_medians(prices: DataFrame) -> DataFrame:
    """Exact median price per country, month and family, sacks brought to one kg."""
    rows = panel.normalise_sacks(series.with_month(prices))
    rows = panel.only_groups(rows, names.NATIONAL_STAPLES, ignore_case=True)
    return panel.median_by(rows, PANEL_KEYS, "usdprice")


def macro_months(macro: DataFrame) -> DataFrame:
    return series.with_month(macro).select("month", "energy_index", "food_index", "fertilizer_index")


def area_index(grid: DataFrame, layers: DataFrame, out: dict[int, str], keys: Sequence[str],
               scales: Sequence[int] = index.ANALYSED_SCALES) -> DataFrame:
    """Mean index per area, month and scale.

    Cells get their areas before the scales multiply the rows.
    """
    # The locations and the rows that get them read the grid; what it is made from is read once.
    enriched = spatial.enrich_locations(kept(grid, "grid"), layers, out)
    return panel.mean_by_month(index.spi(enriched, scales), [*keys, "scale"], "spi", "spi")


def country_index(grid: DataFrame, layers: DataFrame, scales: Sequence[int] = index.ANALYSED_SCALES) -> DataFrame:
    countries = layers.filter("level = 0")
    rows = area_index(grid, countries, {0: "countryiso3"}, ["countryiso3"], scales)
    return rows.select("countryiso3", "month", "scale", "spi")


def country_index_wide(grid: DataFrame, layers: DataFrame, scales: Sequence[int] = index.ANALYSED_SCALES) -> DataFrame:
    return panel.pivot_mean(country_index(grid, layers, scales), ["countryiso3", "month"], "scale", scales, "spi", "spi_")


def price_index_rows(prices: DataFrame, indices: DataFrame) -> DataFrame:
    """Price panel with one row per index scale."""
    return panel.join_on(prices, indices, ["countryiso3", "month"])


def split_correlations(prices: DataFrame, grid: DataFrame, layers: DataFrame) -> DataFrame:
    """How strongly prices move with the index, overall and in its two phases."""
    rows = price_index_rows(monthly_prices(prices), country_index(grid, layers))
    return correlation.split_correlation(rows, ["commodity_group", "scale"], "price_per_kg", "spi")


def with_logs(rows: DataFrame, price: str) -> DataFrame:
    return rows.withColumns({
        "log_price": log_of(F.col(price)), "log_energy": log_of(F.col("energy_index")),
        "log_food": log_of(F.col("food_index"))})


def regression_rows(prices: DataFrame, indices: DataFrame, macro: DataFrame, price: str) -> DataFrame:
    """Prices, index by scale, its drought and flood parts (0 where there is no index) and log controls."""
    rows = panel.join_on(price_index_rows(prices, indices), macro_months(macro), ["month"], "left")
    rows = with_logs(rows, price).withColumns({
        "spi_drought": below(F.col("spi"), -0.5), "spi_flood": above(F.col("spi"), 0.5)})
    # Correlations, fits and residuals all read these few rows; the tables behind them are read once.
    return kept(rows, "regression-rows")


def at_best_scale(rows: DataFrame, keys: Sequence[str], price: str, mode: str, min_n: int = 20) -> DataFrame:
    """The rows of each group at its best correlated scale, with that correlation."""
    corrs = correlation.grouped_corr(rows, [*keys, "scale"], price, "spi", min_n)
    best = correlation.best_scale(corrs, keys, mode=mode).select(*keys, "scale", F.col("corr").alias("best_corr"))
    return rows.join(best, [*keys, "scale"])


def pooled_impact(prices: DataFrame, indices: DataFrame, macro: DataFrame) -> DataFrame:
    """Log price on index, energy and food with country effects, at the best scale."""
    rows = regression_rows(monthly_usd_prices(prices), indices, macro, "usdprice")
    best = at_best_scale(rows, ["commodity_group"], "usdprice", "min")
    xs = ["spi", "log_energy", "log_food"]
    fit = regression.grouped_ols(best, ["commodity_group", "scale", "best_corr"], "log_price", xs, "countryiso3")
    return fit.select("commodity_group", F.col("scale").alias("best_spi_scale"), F.col("best_corr").alias("correlation"),
                      F.col("coef_spi").alias("spi_coefficient"), F.col("p_spi").alias("spi_pvalue"),
                      F.col("n").alias("n_obs"), F.col("r2").alias("r_squared"))


NATIONAL_KEYS = ["countryiso3", "commodity_group"]
SPLIT_TERMS = ["spi_drought", "spi_flood", "log_energy", "log_food"]


def national_rows(prices: DataFrame, indices: DataFrame, macro: DataFrame) -> DataFrame:
    return regression_rows(national_medians(prices), indices, macro, "usdprice")


def national_impact(prices: DataFrame, indices: DataFrame, macro: DataFrame) -> DataFrame:
    """Drought and flood effect per country and commodity at the strongest scale."""
    best = at_best_scale(national_rows(prices, indices, macro), NATIONAL_KEYS, "usdprice", "abs", 21)
    fit = regression.grouped_ols(best, [*NATIONAL_KEYS, "scale", "best_corr"], "log_price", SPLIT_TERMS)
    return fit.select(*NATIONAL_KEYS, "scale", F.col("best_corr").alias("corr_raw"),
                      F.col("coef_spi_drought").alias("coef_drought"), F.col("p_spi_drought").alias("pval_drought"),
                      F.col("coef_spi_flood").alias("coef_flood"), F.col("p_spi_flood").alias("pval_flood"), "r2")


ADMIN2_KEYS = ["country_iso", "admin2", "commodity_group"]
ADMIN2_LAGS = (1, 2, 3, 6)


def admin2_prices(prices: DataFrame, truncate_first: bool = False) -> DataFrame:
    """Mean price per kg by district, date and family.

    Prices are averaged per day and the day is then cut to its month, so a month may keep
    several rows; ``truncate_first`` averages per month instead.
    """
    rows = panel.positive_weight(panel.price_per_kg(prices, "kg_or_litre"))
    rows = panel.only_groups(panel.only_commodities(rows, names.STAPLES_AND_TEFF), names.STAPLES_AND_TEFF)
    rows = rows.withColumnRenamed("countryiso3", "country_iso")
    if truncate_first:
        rows = rows.withColumn("date", month_start(F.col("date")))
    means = panel.mean_by(rows, ["country_iso", "admin2", "date", "commodity_group"], "price_per_kg")
    return means.withColumn("day", F.col("date")).withColumn("date", month_start(F.col("date")))


def admin2_index(grid: DataFrame, layers: DataFrame, scale: int = 6) -> DataFrame:
    rows = area_index(grid, layers, {0: "country_iso", 2: "admin2"}, ["country_iso", "admin2"], [scale])
    return rows.select("country_iso", "admin2", F.col("month").alias("date"), F.col("spi").alias("spi_6m"))


def admin2_panel(prices: DataFrame, grid: DataFrame, layers: DataFrame, truncate_first: bool = False) -> DataFrame:
    """District panel with the price some rows earlier and the month number; complete rows."""
    rows = panel.join_on(admin2_prices(prices, truncate_first), admin2_index(grid, layers), ["country_iso", "admin2", "date"])
    rows = rows.dropna(subset=["price_per_kg", "spi_6m"])
    rows = series.lag_rows(rows, Series(tuple(ADMIN2_KEYS), "day"), "price_per_kg", ADMIN2_LAGS, "price_lag")
    return rows.withColumn("month", F.month("date")).dropna()


def forecast_panel(prices: DataFrame, indices_wide: DataFrame, macro: DataFrame, scale: int = 12,
                   flag_scale: int | None = None) -> DataFrame:
    """Regular monthly series per country and family with the outside factors of the models.

    The drought and flood flags look at the index of ``flag_scale``, the amounts beside them at
    that of ``scale``; a month without an index counts as neither.
    """
    s = Series(tuple(NATIONAL_KEYS), "month")
    rows = panel.join_on(national_medians(prices), indices_wide, ["countryiso3", "month"])
    rows = panel.join_on(rows, macro_months(macro), ["month"], "left")
    rows = prepare(rows, s, "usdprice")
    spi, flag = F.col(f"spi_{scale}"), F.col(f"spi_{flag_scale or scale}")
    rows = rows.withColumns({
        "log_energy": log_of(F.col("energy_index")), "log_food": log_of(F.col("food_index")),
        "log_fertilizer": log_of(F.col("fertilizer_index")),
        "drought_severe": F.when(flag < 0.5, 1).otherwise(0), "flood_severe": F.when(flag > 0.5, 1).otherwise(0),
        "drought_spi": F.when(flag < 0, spi).otherwise(0.0), "flood_spi": F.when(flag > 0, spi).otherwise(0.0),
        "spi_lag_6": F.lag(flag, 6).over(s.window())})
    return kept(rows, "forecast-panel")


def with_best_scale(rows: DataFrame, s: Series, price: str = "usdprice",
                    scales: Sequence[int] = index.ANALYSED_SCALES) -> DataFrame:
    """The index of each series at the scale where prices fall with it most, its drought and
    flood parts and these some months earlier. All scales are correlated in one aggregation."""
    p = F.col(price)
    corrs = [F.struct(safe_corr(p, F.col(f"spi_{k}")).alias("corr"), F.lit(k).alias("scale")) for k in scales]
    best = rows.groupBy(*s.keys).agg(F.array_min(F.filter(F.array(*corrs), lambda c: c["corr"].isNotNull())).alias("b"))
    best = best.select(*s.keys, F.coalesce("b.scale", F.lit(scales[-1])).alias("best_scale"))
    spi = F.element_at(F.create_map(*[v for k in scales for v in (F.lit(k), F.col(f"spi_{k}"))]), F.col("best_scale"))
    out = rows.join(best, list(s.keys)).withColumn("best_spi", spi)
    out = out.withColumns({"drought": below(F.col("best_spi"), -0.5), "flood": above(F.col("best_spi"), 0.5)})
    # The lag with the best effect differs by family; both are positional on the dense series.
    w = s.window()
    lag = lambda c: F.when(F.col("commodity_group").contains("Sorghum"), F.lag(c, 9).over(w)).otherwise(F.lag(c, 7).over(w))
    return out.withColumns({"drought_lag": lag("drought"), "flood_lag": lag("flood")})


FORECAST_FACTORS = ["drought_lag", "flood_lag", "log_energy", "log_food"]


def market_inflation(prices: DataFrame, commodity: str = "Sorghum", time: str = "month") -> DataFrame:
    """Monthly unit price of one commodity family per market and its change."""
    rows = panel.price_per_kg(prices, "first_digits").filter(F.contains("commodity", F.lit(commodity)))
    means = panel.mean_by(series.with_month(rows), ["market_id", "month"], "price_per_kg", "per_unit_price")
    return series.percent_change(means, Series(("market_id",), "month"), "per_unit_price", "inflation_rate")
