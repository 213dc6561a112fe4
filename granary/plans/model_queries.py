"""Index, regressions, stationarity, forecasts, trees, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import clusters, forecast, index, regression, stationarity, summary, trees
from granary.operators.series import Series, as_monthly, calendar_features, interpolate, lag_months, split_at
from granary.plans import flows
from granary.plans.check_sql import add, guarded_corr, normal_quantile, ols, t_pvalue
from granary.plans.registry import cte, query
from granary.sources.tables import kept


# --- index -----------------------------------------------------------------------------

@query("h1_index", "iy ix time:d scale spi:5", "SELECT iy, ix, time, scale, spi FROM spi_rows")
def spi(t):
    return index.spi(t.grid_precip)


@query("h1_gamma_fit", "iy ix time:d scale alpha:4 beta:4 zero_share:6", """
SELECT r.iy, r.ix, r.time, r.scale, alpha, beta, zero_share FROM rain_sums r
LEFT JOIN gamma_fit f ON f.iy = r.iy AND f.ix = r.ix AND f.scale = r.scale AND f.mo = month(r.time)""")
def gamma_fit(t):
    totals = index.accumulate_scales(t.grid_precip, "precip", index.ANALYSED_SCALES)
    return index.fit_gamma(totals, "total", ["iy", "ix", "scale"])


_CALIBRATED = (f"CASE WHEN year(time) BETWEEN greatest({index.CALIBRATION[0]}, (SELECT min(year(time)) FROM grid_precip)) "
               f"AND least({index.CALIBRATION[1]}, (SELECT max(year(time)) FROM grid_precip)) THEN total END")


@query("h1_calibrated_index_fit", "iy ix mo scale alpha:4 beta:4 zero_share:6", f"""
SELECT iy, ix, scale, mo, zero_share, (1 + sqrt(1 + 4 * spread / 3)) / (4 * spread) AS alpha,
       mean / ((1 + sqrt(1 + 4 * spread / 3)) / (4 * spread)) AS beta
FROM (SELECT iy, ix, scale, month(time) AS mo, avg(x) FILTER (WHERE x > 0) AS mean,
             CASE WHEN ln(avg(x) FILTER (WHERE x > 0)) - avg(ln(CASE WHEN x > 0 THEN x END)) > 1e-12
               THEN ln(avg(x) FILTER (WHERE x > 0)) - avg(ln(CASE WHEN x > 0 THEN x END)) END AS spread,
             count(*) FILTER (WHERE x = 0) / nullif(count(x), 0) AS zero_share
      FROM (SELECT *, {_CALIBRATED} AS x FROM rain_sums) y GROUP BY ALL) m""")
def calibrated_index_fit(t):
    totals = index.accumulate_scales(t.grid_precip, "precip", index.ANALYSED_SCALES)
    years = t.grid_precip.agg(F.min(F.year("time")), F.max(F.year("time"))).first()
    calibration = index.clamp_calibration(index.CALIBRATION, tuple(years)) if years[0] else None
    fit = index.fit_gamma(totals, "total", ["iy", "ix", "scale"], calibration)
    return fit.select("iy", "ix", "scale", F.month("time").alias("mo"), "alpha", "beta", "zero_share").dropDuplicates(
        ["iy", "ix", "scale", "mo"])


# --- regressions -----------------------------------------------------------------------

add(ols("pooled_best", ["commodity_group", "scale", "best_corr"], "log_price", ["spi", "log_energy", "log_food"], "pooled_ols", "countryiso3"))


@query("h2_pooled_impact", "commodity_group best_spi_scale correlation:5 spi_coefficient:5 spi_pvalue:4 n_obs r_squared:5", f"""
SELECT commodity_group, scale AS best_spi_scale, best_corr AS correlation, coef_spi AS spi_coefficient,
       {t_pvalue('(coef_spi / se_spi)', 'df_resid')} AS spi_pvalue, n AS n_obs, r2 AS r_squared FROM pooled_ols_fit""")
def pooled_impact(t):
    return flows.pooled_impact(t.price_obs, flows.country_index(t.grid_precip, t.grid_layers), t.macro_index)


@query("h2_country_effects", "commodity_group countryiso3 level:4 versus_base:4", """
SELECT commodity_group, countryiso3, level, level - first_value(level) OVER (PARTITION BY commodity_group ORDER BY countryiso3) AS versus_base
FROM (SELECT r.commodity_group, countryiso3, avg(log_price) - any_value(coef_spi) * avg(spi) - any_value(coef_log_energy) * avg(log_energy)
             - any_value(coef_log_food) * avg(log_food) AS level
      FROM pooled_rows r JOIN pooled_ols_fit f ON f.commodity_group = r.commodity_group AND f.scale = r.scale
      WHERE log_price IS NOT NULL AND spi IS NOT NULL AND log_energy IS NOT NULL AND log_food IS NOT NULL
      GROUP BY r.commodity_group, countryiso3) x""")
def country_effects(t):
    rows = flows.regression_rows(flows.monthly_usd_prices(t.price_obs), flows.country_index(t.grid_precip, t.grid_layers),
                                 t.macro_index, "usdprice")
    best = flows.at_best_scale(rows, ["commodity_group"], "usdprice", "min")
    xs, keys = ["spi", "log_energy", "log_food"], ["commodity_group"]
    fit = regression.grouped_ols(best, keys, "log_price", xs, "countryiso3")
    return regression.effect_levels(best, fit, keys, "log_price", xs, "countryiso3")


_NATIONAL = ["countryiso3", "commodity_group"]
add(ols("national_best", [*_NATIONAL, "scale", "best_corr"], "log_price", flows.SPLIT_TERMS, "national_ols"))


@query("h3_national_impact", "countryiso3 commodity_group scale corr_raw:5 coef_drought:4 pval_drought:4 coef_flood:4 pval_flood:4 r2:5", f"""
SELECT countryiso3, commodity_group, scale, best_corr AS corr_raw, coef_spi_drought AS coef_drought,
       {t_pvalue('(coef_spi_drought / se_spi_drought)', 'df_resid')} AS pval_drought, coef_spi_flood AS coef_flood,
       {t_pvalue('(coef_spi_flood / se_spi_flood)', 'df_resid')} AS pval_flood, r2 FROM national_ols_fit""")
def national_impact(t):
    return flows.national_impact(t.price_obs, flows.country_index(t.grid_precip, t.grid_layers), t.macro_index)


# These models are fitted on whatever is complete, as long as there are more rows than terms.
_ANY = len(flows.SPLIT_TERMS) + 2
add(ols("national_rows", [*_NATIONAL, "scale"], "log_price", flows.SPLIT_TERMS, "every_ols", min_n=_ANY))


@query("h4_every_scale", "countryiso3 commodity_group scale n r2:5 aic:3 coef_spi_drought:4 p_spi_drought:4 coef_spi_flood:4 p_spi_flood:4", f"""
SELECT countryiso3, commodity_group, scale, n, r2, aic, coef_spi_drought, {t_pvalue('(coef_spi_drought / se_spi_drought)', 'df_resid')} AS p_spi_drought,
       coef_spi_flood, {t_pvalue('(coef_spi_flood / se_spi_flood)', 'df_resid')} AS p_spi_flood FROM every_ols_fit""")
def every_scale(t):
    rows = flows.national_rows(t.price_obs, flows.country_index(t.grid_precip, t.grid_layers), t.macro_index)
    return regression.grouped_ols(rows, [*_NATIONAL, "scale"], "log_price", flows.SPLIT_TERMS, min_n=_ANY)


# Months without an index are left out here, so both models share one sample.
cte("indexed_rows", "SELECT * FROM national_rows WHERE spi IS NOT NULL")
add(ols("indexed_rows", [*_NATIONAL, "scale"], "log_price", ["spi", "log_energy", "log_food"], "raw_ols", min_n=_ANY))
add(ols("indexed_rows", [*_NATIONAL, "scale"], "log_price", flows.SPLIT_TERMS, "split_ols", min_n=_ANY))


@query("h5_model_comparison", "countryiso3 commodity_group scale model n r2:5 aic:3", """
SELECT countryiso3, commodity_group, scale, 'raw' AS model, n, r2, aic FROM raw_ols_fit
UNION ALL SELECT countryiso3, commodity_group, scale, 'split', n, r2, aic FROM split_ols_fit""")
def model_comparison(t):
    rows = flows.national_rows(t.price_obs, flows.country_index(t.grid_precip, t.grid_layers), t.macro_index)
    return regression.compare_models(rows, [*_NATIONAL, "scale"], "log_price", {
        "raw": ["spi", "log_energy", "log_food"], "split": flows.SPLIT_TERMS}, _ANY)


add(ols("national_rows_24", _NATIONAL, "log_price", flows.SPLIT_TERMS, "diag_ols", min_n=_ANY))
cte("national_rows_24", "SELECT * FROM indexed_rows WHERE scale = 24")
_FIT_COLUMNS = "n df_resid r2:5 adj_r2:5 f:3 llf:3 aic:3 bic:3 intercept:3 se_spi_drought:4 se_log_food:4"


def _diagnosed(t):
    rows = flows.national_rows(t.price_obs, flows.country_index(t.grid_precip, t.grid_layers, [24]), t.macro_index)
    rows = rows.dropna(subset=["spi"])
    return rows, regression.grouped_ols(rows, _NATIONAL, "log_price", flows.SPLIT_TERMS, min_n=_ANY)


@query("h6_fit_statistics", f"countryiso3 commodity_group {_FIT_COLUMNS}", """
SELECT f.*, 1 - (1 - r2) * (n - 1) / df_resid AS adj_r2, (sst - sse) / 4 / (sse / df_resid) AS f, -(aic - 10) / 2 AS llf,
       aic - 10 + 5 * ln(n) AS bic, m.intercept
FROM diag_ols_fit f JOIN (SELECT r.countryiso3, r.commodity_group, avg(log_price - coef_spi_drought * spi_drought - coef_spi_flood * spi_flood
    - coef_log_energy * log_energy - coef_log_food * log_food) AS intercept
  FROM diag_ols_rows r JOIN diag_ols_fit g USING (countryiso3, commodity_group) GROUP BY ALL) m USING (countryiso3, commodity_group)""")
def fit_statistics(t):
    return _diagnosed(t)[1]


@query("h6_coefficient_table", "countryiso3 commodity_group term coef:3 se:4 t:3 p:4", "\nUNION ALL ".join(
    f"SELECT countryiso3, commodity_group, '{x}' AS term, coef_{x} AS coef, se_{x} AS se, coef_{x} / se_{x} AS t, "
    f"{t_pvalue(f'(coef_{x} / se_{x})', 'df_resid')} AS p FROM diag_ols_fit" for x in flows.SPLIT_TERMS))
def coefficient_table(t):
    return regression.coefficient_rows(_diagnosed(t)[1], _NATIONAL, flows.SPLIT_TERMS, intercept=False)


@query("h6_residual_diagnostics", "countryiso3 commodity_group n durbin_watson:4 skew:4 kurtosis:4 jarque_bera:3 p_jarque_bera:4", """
SELECT *, exp(-jarque_bera / 2) AS p_jarque_bera FROM (SELECT *, n / 6.0 * (skew * skew + (kurtosis - 3) * (kurtosis - 3) / 4) AS jarque_bera FROM (
 SELECT countryiso3, commodity_group, count(*) AS n, sum(power(e - pe, 2)) / sum(e * e) AS durbin_watson,
        avg(power(e - me, 3)) / power(avg(power(e - me, 2)), 1.5) AS skew, avg(power(e - me, 4)) / power(avg(power(e - me, 2)), 2) AS kurtosis
 FROM (SELECT *, lag(e) OVER (PARTITION BY countryiso3, commodity_group ORDER BY month) AS pe,
              avg(e) OVER (PARTITION BY countryiso3, commodity_group) AS me FROM (
   SELECT countryiso3, commodity_group, month, u - avg(u) OVER (PARTITION BY countryiso3, commodity_group) AS e FROM (
    SELECT r.countryiso3, r.commodity_group, month, log_price - coef_spi_drought * spi_drought - coef_spi_flood * spi_flood
           - coef_log_energy * log_energy - coef_log_food * log_food AS u
    FROM national_rows_24 r JOIN diag_ols_fit USING (countryiso3, commodity_group)
    WHERE log_price IS NOT NULL AND spi IS NOT NULL AND log_energy IS NOT NULL AND log_food IS NOT NULL) a) b) c GROUP BY ALL) d) g""")
def residual_diagnostics(t):
    rows, fit = _diagnosed(t)
    res = regression.fitted_residuals(rows, fit, _NATIONAL, "log_price", flows.SPLIT_TERMS)
    return regression.residual_diagnostics(res, Series(tuple(_NATIONAL)))


@query("h7_trend_lines", "countryiso3 n slope:5 intercept:5 r2:5", """
SELECT countryiso3, regr_count(inflation_rate, precip_anomaly) AS n, regr_slope(inflation_rate, precip_anomaly) AS slope,
       regr_intercept(inflation_rate, precip_anomaly) AS intercept, regr_r2(inflation_rate, precip_anomaly) AS r2
FROM drought_prices GROUP BY countryiso3""")
def trend_lines(t):
    from granary.plans.aggregation_queries import drought_prices
    return summary.trend_line(drought_prices(t), ["countryiso3"], "precip_anomaly", "inflation_rate")


@query("h7_phase_trend_lines", "commodity_group phase n slope:5 intercept:5 r2:5", """
SELECT commodity_group, CASE WHEN spi < 0 THEN 'drought' ELSE 'flood' END AS phase, regr_count(price_per_kg, spi) AS n,
       regr_slope(price_per_kg, spi) AS slope, regr_intercept(price_per_kg, spi) AS intercept, regr_r2(price_per_kg, spi) AS r2
FROM price_spi WHERE scale = 12 AND spi <> 0 GROUP BY ALL""")
def phase_trend_lines(t):
    rows = flows.price_index_rows(flows.monthly_prices(t.price_obs), flows.country_index(t.grid_precip, t.grid_layers, [12]))
    phased = rows.filter("spi <> 0").withColumn("phase", F.when(F.col("spi") < 0, "drought").otherwise("flood"))
    return summary.trend_line(phased, ["commodity_group", "phase"], "spi", "price_per_kg")


# --- time-series models ----------------------------------------------------------------

_S = Series(("series_id",))


@query("h8_stationarity", "form series_id statistic:6 lag n_used p_value:6 stationary")
def stationarity_tests(t):
    dense = interpolate(as_monthly(t.series_months, _S), _S, "price").withColumn("log_price", F.ln("price"))
    w = _S.window()
    forms = F.array(
        F.struct(F.lit("level").alias("form"), F.col("log_price").alias("x")),
        F.struct(F.lit("difference").alias("form"), (F.col("price") - F.lag("price").over(w)).alias("x")),
        F.struct(F.lit("log_difference").alias("form"), (F.col("log_price") - F.lag("log_price").over(w)).alias("x")))
    rows = dense.withColumn("_f", forms).select("series_id", "month", F.inline("_f"))
    return stationarity.stationarity(rows, Series(("form", "series_id")), "x")


def _forecast_panel(t, flag_scale=None):
    return flows.forecast_panel(t.price_obs, flows.country_index_wide(t.grid_precip, t.grid_layers), t.macro_index, flag_scale=flag_scale)


_NS = Series(tuple(_NATIONAL))


@query("h9_forecast_errors", "countryiso3 commodity_group n rmse:6 mae:6 r2:6 pearson_r:6 aic:6 n_train")
def forecast_errors(t):
    rows = flows.with_best_scale(_forecast_panel(t), _NS)
    out = forecast.forecast_arx(rows, _NS, "log_price", flows.FORECAST_FACTORS)
    return forecast.forecast_errors(out, _NATIONAL)


@query("h9_series_scale", "countryiso3 commodity_group best_scale n", f"""
SELECT countryiso3, commodity_group, count(*) AS n, coalesce(any_value(scale), {flows.index.ANALYSED_SCALES[-1]}) AS best_scale
FROM forecast_filled LEFT JOIN (
  SELECT countryiso3, commodity_group, scale FROM (
    SELECT countryiso3, commodity_group, scale, {guarded_corr('usdprice', 'spi')} AS corr FROM (
      SELECT countryiso3, commodity_group, usdprice, unnest([{', '.join(f'spi_{k}' for k in flows.index.ANALYSED_SCALES)}]) AS spi,
             unnest([{', '.join(map(str, flows.index.ANALYSED_SCALES))}]) AS scale FROM forecast_filled) GROUP BY ALL)
  WHERE corr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY countryiso3, commodity_group ORDER BY corr, scale) = 1) b
USING (countryiso3, commodity_group) GROUP BY ALL""")
def series_scale(t):
    rows = flows.with_best_scale(_forecast_panel(t), _NS)
    return rows.groupBy(*_NATIONAL, "best_scale").agg(F.count(F.lit(1)).alias("n"))


#: Held-out months and factors of the wide model.
WIDE_HOLD_OUT = 18
WIDE_FACTORS = ["log_energy", "energy_index", "fertilizer_index", "food_index", "log_fertilizer", "log_food", "drought_severe",
                "flood_severe", "drought_spi", "flood_spi", "log_drought_spi", "log_flood_spi", "spi_lag_6"]


@query("h9_wide_forecast_errors", "countryiso3 commodity_group n rmse:6 mae:6 r2:6 pearson_r:6 aic:6 n_train")
def wide_forecast_errors(t):
    plus_one = lambda c: F.when(F.col(c) > -1, F.ln(F.col(c) + 1))
    rows = _forecast_panel(t).withColumns({"log_drought_spi": plus_one("drought_spi"), "log_flood_spi": plus_one("flood_spi")})
    out = forecast.forecast_arx(rows, _NS, "log_price", WIDE_FACTORS, hold_out=WIDE_HOLD_OUT)
    return forecast.forecast_errors(out, _NATIONAL)


@query("h10_forecast_interval", "countryiso3 commodity_group month:d actual:6 predicted:6 lower:6 upper:6")
def forecast_interval(t):
    return forecast.forecast_arx(flows.with_best_scale(_forecast_panel(t), _NS), _NS, "log_price", flows.FORECAST_FACTORS)


CANDIDATES = ["log_energy", "log_fertilizer", "drought_severe", "drought_spi", "flood_severe", "spi_lag_6"]


#: The index scale behind the drought and flood flags of the subset search and the tree models.
FLAG_SCALE = 3


@query("h11_feature_subsets", "countryiso3 commodity_group features num_vars n rmse:6 r2:6 aic:6 rank")
def feature_subsets(t):
    return forecast.feature_subsets(_forecast_panel(t, FLAG_SCALE), _NS, "log_price", CANDIDATES)


@query("h12_order_search", "countryiso3 commodity_group model_order aic:6 rmse:6 r2:6 n_train")
def order_search(t):
    return forecast.order_search(_forecast_panel(t, FLAG_SCALE), _NS, "log_price", ["log_energy", "drought_spi", "flood_spi"])


# --- trees -----------------------------------------------------------------------------

PANEL_FEATURES = ["spi_6m", "month", *[f"price_lag_{k}" for k in flows.ADMIN2_LAGS],
                  "commodity_group_code", "country_iso_code", "admin2_code"]
_PANEL_SPLIT = "2000-01-01"


def _encoded_panel(t):
    # The codes, the split and whoever asks for the densest district all read the panel.
    panel = kept(flows.admin2_panel(t.price_obs, t.grid_precip, t.grid_layers), "panel")
    coded, mapping = summary.encode(panel, ["commodity_group", "country_iso", "admin2"])
    first = F.lit(_PANEL_SPLIT).cast("date")
    return coded.withColumn("split", F.when(F.col("date") < first, "train").otherwise("test")), mapping


def _panel_forest(rows):
    keep = ["country_iso", "admin2", "commodity_group", "date", "day"]
    return trees.fit_and_score(rows, trees.forest("price_per_kg"), PANEL_FEATURES, "price_per_kg", keep)


@query("h13_panel_forest", "split n rmse:6 mae:6 r2:6 pearson_r:6")
def panel_forest(t):
    return summary.fit_metrics(_panel_forest(_encoded_panel(t)[0])[0], ["split"])


SERIES_FEATURES = [*[f"lag_price_{k}" for k in trees.PRICE_LAGS], "roll_mean_3", "roll_mean_6", "roll_std_6", "month_num",
                   "log_energy", "drought_severe", "drought_spi", "flood_severe", "spi_lag_6"]


def _series_rows(t):
    return trees.series_features(_forecast_panel(t, FLAG_SCALE), _NS)


def _series_fits(t, model):
    return trees.series_fits(_series_rows(t), _NS, "log_price", SERIES_FEATURES, model, forecast.HOLD_OUT)


_SERIES_ERRORS = "countryiso3 commodity_group split n rmse:6 mae:6 r2:6 pearson_r:6"


@query("h13_series_forest", _SERIES_ERRORS)
def series_forest(t):
    fits = _series_fits(t, trees.forest_model(**trees.SERIES_FOREST))
    return summary.fit_metrics(trees.fitted_months(fits, _NATIONAL), [*_NATIONAL, "split"])


@query("h14_boosted_trees", _SERIES_ERRORS)
def boosted_trees(t):
    fits = _series_fits(t, trees.boosting_model(**trees.SERIES_BOOSTING))
    return summary.fit_metrics(trees.fitted_months(fits, _NATIONAL), [*_NATIONAL, "split"])


def _scan(t):
    rows = lag_months(_forecast_panel(t, FLAG_SCALE), _NS, "log_price", (1, 3, 12), "lag_price")
    base = ["lag_price_1", "lag_price_3", "lag_price_12", "month_num"]
    return trees.drought_lag_scan(calendar_features(rows, "month"), _NS, "log_price", "spi_12", "drought_severe", base)


@query("h15_drought_lag_scan", "countryiso3 commodity_group lag n n_train rmse:6 r2:6 best")
def drought_lag_scan(t):
    return _scan(t)


# What the check engine can say of the scan: which months a lag has, and that boosting explains some of them.
@query("h15_lag_samples", "countryiso3 commodity_group lag n n_train sst_train:6 learned", f"""
SELECT countryiso3, commodity_group, lag, count(*) AS n, count(*) - 12 AS n_train,
       regr_syy(log_price, log_price) FILTER (WHERE back > 12) AS sst_train, TRUE AS learned FROM (
  SELECT *, row_number() OVER (PARTITION BY countryiso3, commodity_group, lag ORDER BY month DESC) AS back FROM (
    SELECT f.countryiso3, f.commodity_group, f.month, f.log_price, k.lag FROM forecast_lags f
    CROSS JOIN (SELECT unnest(range(0, 25)) AS lag) k
    JOIN forecast_lags e ON e.countryiso3 = f.countryiso3 AND e.commodity_group = f.commodity_group AND e.i = f.i - k.lag
    WHERE f.log_price IS NOT NULL AND f.l1 IS NOT NULL AND f.l3 IS NOT NULL AND f.l12 IS NOT NULL AND e.spi_12 IS NOT NULL))
GROUP BY ALL HAVING count(*) >= {trees.SCAN_MIN_ROWS}""")
def lag_samples(t):
    return _scan(t).withColumn("learned", F.col("sse_train") < F.col("sst_train"))


@query("h16_feature_importance", "countryiso3 commodity_group feature importance:6 rank")
def feature_importance(t):
    fits = _series_fits(t, trees.forest_model(**trees.SERIES_FOREST))
    return trees.feature_weights(fits, _NATIONAL, SERIES_FEATURES, top=10)


@query("h16_series_samples", "countryiso3 commodity_group n n_train total:6", f"""
SELECT countryiso3, commodity_group, count(*) AS n, count(*) - {forecast.HOLD_OUT} AS n_train, CASE WHEN regr_syy(log_price, log_price) FILTER (WHERE back > {forecast.HOLD_OUT}) > 1e-12 THEN 1.0 ELSE 0.0 END AS total FROM (
 SELECT *, row_number() OVER (PARTITION BY countryiso3, commodity_group ORDER BY month DESC) AS back FROM (
  SELECT *, {{deviation}} AS roll_std_6 FROM (SELECT *, lag(log_price, 1) OVER w AS p1, lag(log_price, 2) OVER w AS p2,
    lag(log_price, 3) OVER w AS p3, lag(log_price, 4) OVER w AS p4, lag(log_price, 5) OVER w AS p5, lag(log_price, 6) OVER w AS p6,
    lag(log_price, 12) OVER w AS p12, lag(log_price, 24) OVER w AS p24, lag(spi_3, 6) OVER w AS s6
  FROM forecast_lags WINDOW w AS (PARTITION BY countryiso3, commodity_group ORDER BY month)))
WHERE log_price IS NOT NULL AND roll_std_6 AND p12 IS NOT NULL AND p24 IS NOT NULL AND s6 IS NOT NULL AND energy_index IS NOT NULL
  AND (spi_3 IS NULL OR spi_3 >= 0 OR spi_12 IS NOT NULL)) kept
GROUP BY ALL HAVING count(*) > {forecast.HOLD_OUT}""".replace("{deviation}", " AND ".join(f"p{k} IS NOT NULL" for k in range(1, 7))))
def series_samples(t):
    fits = _series_fits(t, trees.forest_model(20, 3))
    return fits.select(*_NATIONAL, F.size("months").alias("n"),
                       F.size(F.filter("months", lambda m: m["split"] == "train")).alias("n_train"),
                       F.aggregate("weights", F.lit(0.0), lambda a, w: a + w).alias("total"))


@query("h17_fit_metrics", "split n rmse:3 mae:3 r2:6 pearson_r:6", f"""
SELECT split, count(*) AS n, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, avg(abs(actual - predicted)) AS mae,
       1 - sum((actual - predicted) * (actual - predicted)) / regr_syy(actual, actual) AS r2, {guarded_corr('actual', 'predicted')} AS pearson_r
FROM predictions GROUP BY split""")
def fit_metrics(t):
    return summary.fit_metrics(t.predictions, ["split"])


@query("h18_residuals", "split date:d actual predicted residual", "SELECT *, actual - predicted AS residual FROM predictions")
def residuals(t):
    return summary.residuals(t.predictions)


@query("h19_encoding", "countryiso3 commodity admin2 commodity_code admin2_code n", """
SELECT countryiso3, commodity, admin2, c AS commodity_code, coalesce(a, -1) AS admin2_code, count(*) AS n FROM price_obs
LEFT JOIN (SELECT commodity, row_number() OVER (ORDER BY commodity) - 1 AS c FROM price_obs GROUP BY commodity) x USING (commodity)
LEFT JOIN (SELECT admin2, row_number() OVER (ORDER BY admin2) - 1 AS a FROM price_obs WHERE admin2 IS NOT NULL GROUP BY admin2) y USING (admin2)
GROUP BY ALL""")
def encoding(t):
    coded, _ = summary.encode(t.price_obs, ["commodity", "admin2"])
    return coded.groupBy("countryiso3", "commodity", "admin2", "commodity_code", "admin2_code").agg(F.count(F.lit(1)).alias("n"))


@query("h19_encoding_table", "variable value code", """
SELECT 'commodity' AS variable, commodity AS value, row_number() OVER (ORDER BY commodity) - 1 AS code FROM price_obs GROUP BY commodity
UNION ALL SELECT 'admin2', admin2, row_number() OVER (ORDER BY admin2) - 1 FROM price_obs WHERE admin2 IS NOT NULL GROUP BY admin2""")
def encoding_table(t):
    return summary.encode(t.price_obs, ["commodity", "admin2"])[1]


cte("dense_inflation", """
SELECT market_id, month, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(x IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS inflation_rate
FROM (SELECT market_id, CAST(month AS DATE) AS month, r.x FROM (
   SELECT market_id, unnest(generate_series((SELECT min(month) FROM valid_inflation), (SELECT max(month) FROM valid_inflation), INTERVAL 1 MONTH)) AS month
   FROM (SELECT DISTINCT market_id FROM valid_inflation) v) g
 LEFT JOIN (SELECT market_id, CAST(month AS TIMESTAMP) AS month, inflation_rate AS x FROM valid_inflation) r USING (market_id, month)) d""")
cte("valid_inflation", """
SELECT market_id, month, inflation_rate FROM market_inflation WHERE market_id IN
 (SELECT market_id FROM market_inflation GROUP BY market_id HAVING count(inflation_rate) >= 20)""")


def _standardised(t):
    dense = clusters.dense_series(flows.market_inflation(t.price_obs), "market_id", "month", "inflation_rate")
    return clusters.standardise_by_date(dense, "month", "inflation_rate")


@query("h20_standardised_by_date", "market_id month:d inflation_rate:5 z:4", """
SELECT *, CASE WHEN stddev_pop(inflation_rate) OVER w > 0 THEN (inflation_rate - avg(inflation_rate) OVER w) / stddev_pop(inflation_rate) OVER w
  ELSE 0 END AS z FROM dense_inflation WINDOW w AS (PARTITION BY month)""")
def standardised_by_date(t):
    return _standardised(t)


@query("h21_cluster_sweep", "k inertia:6 silhouette:6")
def cluster_sweep(t):
    return clusters.sweep(clusters.market_vectors(_standardised(t), "market_id", "month"))


@query("h22_market_clusters", "market_id cluster market countryiso3 latitude longitude")
def market_clusters(t):
    labels = clusters.assign(clusters.market_vectors(_standardised(t), "market_id", "month"), "market_id")
    return clusters.membership(labels, t.price_obs, "market_id", ["market", "countryiso3", "latitude", "longitude"])


cte("rate_values", "SELECT inflation_rate AS x, count(*) AS c FROM market_inflation WHERE inflation_rate IS NOT NULL GROUP BY ALL")
cte("rate_starts", "SELECT list(x ORDER BY x) AS m FROM (SELECT DISTINCT unnest(quantile_cont(inflation_rate, [" + ", ".join(
    str((i + 0.5) / clusters.RATE_K) for i in range(clusters.RATE_K)) + "])) AS x FROM market_inflation)")
_NEAREST = "len(list_filter(range(1, len(m)), lambda j: x > (m[j] + m[j + 1]) / 2))"


@query("h23_rate_clusters", "market_id month:d inflation_rate:6 cluster", f"""
SELECT market_id, month, x AS inflation_rate, {_NEAREST} AS cluster
FROM (SELECT market_id, month, inflation_rate AS x FROM market_inflation WHERE inflation_rate IS NOT NULL) r, (
  WITH RECURSIVE lloyd AS (
    SELECT 0 AS i, m FROM rate_starts
    UNION ALL
    SELECT i + 1, (SELECT list(a ORDER BY a) FROM (SELECT sum(x * c) / sum(c) AS a FROM rate_values GROUP BY {_NEAREST}))
    FROM lloyd WHERE i < {clusters.ROUNDS})
  SELECT m FROM lloyd WHERE i = {clusters.ROUNDS}) centres""")
def rate_clusters(t):
    return clusters.rate_clusters(flows.market_inflation(t.price_obs), "inflation_rate")


cte("densest_district", """
SELECT country_iso, admin2, commodity_group FROM admin2_panel WHERE date >= DATE '2000-01-01' AND admin2 = (
  SELECT admin2 FROM admin2_panel WHERE date >= DATE '2000-01-01' GROUP BY admin2 ORDER BY count(*) DESC, admin2 LIMIT 1)
GROUP BY ALL ORDER BY count(*) DESC, commodity_group LIMIT 1""")


def _densest(t):
    rows, _ = _encoded_panel(t)
    from granary.operators.panel import keep_members
    test = rows.filter("split = 'test'")
    district = summary.mode_of(test, "admin2").select("admin2")
    family = summary.mode_of(keep_members(test, district, ["admin2"]), "commodity_group", ["admin2"])
    return rows, family.select("admin2", "commodity_group")


@query("h24_densest_slice", "country_iso admin2 commodity_group date:d day:d price_per_kg:4", """
SELECT p.country_iso, p.admin2, p.commodity_group, date, day, price_per_kg FROM admin2_panel p
JOIN densest_district d ON d.admin2 = p.admin2 AND d.commodity_group = p.commodity_group""")
def densest_slice(t):
    from granary.operators.panel import keep_members
    rows, chosen = _densest(t)
    return keep_members(rows, chosen, ["admin2", "commodity_group"])


@query("h24_example_forecast", "country_iso admin2 commodity_group date:d split actual:6 predicted:6")
def example_forecast(t):
    from granary.operators.panel import keep_members
    rows, chosen = _densest(t)
    return keep_members(_panel_forest(rows)[0], chosen, ["admin2", "commodity_group"])
