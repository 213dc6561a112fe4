"""Groupings, correlations, summaries, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import names
from granary.operators import clusters, correlation, grids, index, panel, series, summary
from granary.operators.index import ANALYSED_SCALES
from granary.operators.series import Series
from granary.plans import flows
from granary.plans.check_sql import (
    MONTH, WEIGHT_FIRST_NUMBER, any_of, family, filled, guarded_corr, normal_quantile, split_corr, t_pvalue,
)
from granary.plans.join_queries import cell_panel
from granary.plans.registry import cte, query


@query("d1_monthly_mean_price", "countryiso3 month:d commodity_group price_per_kg:5", "SELECT * FROM monthly_price")
def monthly_mean_price(t):
    return flows.monthly_prices(t.price_obs)


@query("d2_monthly_median_price", "countryiso3 month:d commodity_group usdprice:5", "SELECT * FROM national_median")
def monthly_median_price(t):
    return flows.national_medians(t.price_obs)


@query("d2_regional_median_price", "month:d commodity_group usdprice:5", f"""
SELECT {MONTH.format('date')} AS month, {family('commodity', names.NATIONAL_STAPLES, True)} AS commodity_group,
       median(CASE WHEN unit = '100 KG' THEN usdprice / 100 ELSE usdprice END) AS usdprice FROM price_obs GROUP BY ALL""")
def regional_median_price(t):
    rows = panel.group_commodities(panel.normalise_sacks(series.with_month(t.price_obs)), names.NATIONAL_STAPLES, True)
    return panel.median_by(rows, ["month", "commodity_group"], "usdprice")


@query("d3_country_month_index", "countryiso3 month:d scale spi:5", "SELECT * FROM country_spi")
def country_month_index(t):
    return flows.country_index(t.grid_precip, t.grid_layers)


@query("d4_admin2_month_index", "country_iso admin2 date:d spi_6m:5", "SELECT * FROM admin2_spi")
def admin2_month_index(t):
    return flows.admin2_index(t.grid_precip, t.grid_layers)


@query("d4_admin2_centroids", "admin1 admin2 latitude:6 longitude:6", """
SELECT admin1, admin2, avg(latitude) AS latitude, avg(longitude) AS longitude FROM price_obs
WHERE admin2 IS NOT NULL GROUP BY admin1, admin2""")
def admin2_centroids(t):
    return panel.centroids(t.price_obs, ["admin1", "admin2"], "latitude", "longitude")


_WIDE = " ".join(f"spi_{k}:5" for k in ANALYSED_SCALES)


@query("d5_pivot_scales", f"countryiso3 month:d {_WIDE}", "SELECT * FROM country_spi_wide")
def pivot_scales(t):
    return flows.country_index_wide(t.grid_precip, t.grid_layers)


@query("d6_unpivot_correlations", "commodity_group scale condition correlation:5", """
SELECT commodity_group, scale, CASE condition WHEN 'corr_overall' THEN 'Overall' WHEN 'corr_drought' THEN 'Drought (SPI<0)'
  ELSE 'Flood (SPI>0)' END AS condition, correlation FROM (
 SELECT commodity_group, scale, unnest(['corr_overall', 'corr_drought', 'corr_flood']) AS condition,
        unnest([corr_overall, corr_drought, corr_flood]) AS correlation FROM split_corr) x""")
def unpivot_correlations(t):
    wide = flows.split_correlations(t.price_obs, t.grid_precip, t.grid_layers)
    rows = panel.unpivot(wide, ["commodity_group", "scale"], list(correlation.CONDITION_LABELS), "condition", "correlation")
    return rows.withColumn("condition", names.relabel(F.col("condition"), correlation.CONDITION_LABELS))


@query("d7_guarded_correlation", "countryiso3 commodity_group scale n corr:5", f"""
SELECT countryiso3, commodity_group, scale, count(CASE WHEN price_per_kg IS NOT NULL THEN spi END) AS n,
       {guarded_corr('price_per_kg', 'spi')} AS corr FROM price_spi GROUP BY countryiso3, commodity_group, scale
HAVING count(CASE WHEN price_per_kg IS NOT NULL THEN spi END) >= 20""")
def guarded_correlation(t):
    rows = flows.price_index_rows(flows.monthly_prices(t.price_obs), flows.country_index(t.grid_precip, t.grid_layers))
    return correlation.grouped_corr(rows, ["countryiso3", "commodity_group", "scale"], "price_per_kg", "spi")


_SPLIT = "n_total n_drought n_flood corr_overall:5 corr_drought:5 corr_flood:5"


@query("d8_split_correlation", f"commodity_group scale {_SPLIT}", "SELECT * FROM split_corr")
def split_correlation(t):
    return flows.split_correlations(t.price_obs, t.grid_precip, t.grid_layers)


@query("d8_national_split_correlation", f"countryiso3 commodity_group scale {_SPLIT}",
       split_corr("countryiso3, commodity_group, scale", "price_per_kg", "spi", "price_spi", 20, 2))
def national_split_correlation(t):
    rows = flows.price_index_rows(flows.monthly_prices(t.price_obs), flows.country_index(t.grid_precip, t.grid_layers))
    return correlation.split_correlation(rows, ["countryiso3", "commodity_group", "scale"], "price_per_kg", "spi", min_split_n=2)


cte("lag_rows", """
SELECT p.countryiso3, p.commodity_group, p.month, p.usdprice AS price, s.spi
FROM national_median p LEFT JOIN (SELECT * FROM country_spi WHERE scale = 6) s ON s.countryiso3 = p.countryiso3 AND s.month = p.month""")
cte("lag_filled", filled("lag_rows", "countryiso3, commodity_group", "month", "price", "spi")["filled"])
cte("lag_series", """
SELECT countryiso3, commodity_group, month, ln(price + 1e-6) AS price, coalesce(spi, 0.0) AS spi FROM lag_filled WHERE price + 1e-6 > 0""")
cte("lag_pairs", """
SELECT a.countryiso3, a.commodity_group, k AS lag, a.price, b.spi
FROM lag_series a CROSS JOIN (SELECT unnest(range(0, 13)) AS k) l
JOIN lag_series b ON b.countryiso3 = a.countryiso3 AND b.commodity_group = a.commodity_group
  AND b.month = CAST(a.month - to_months(CAST(k AS INT)) AS DATE)""")
_LAGS = f"""SELECT countryiso3, commodity_group, lag, count(*) AS n,
       {guarded_corr('price', 'spi')} AS corr FROM lag_pairs GROUP BY countryiso3, commodity_group, lag"""
cte("lag_corrs", _LAGS)


def _lag_scan(t):
    spi = flows.country_index(t.grid_precip, t.grid_layers, [6]).drop("scale")
    rows = panel.join_on(flows.national_medians(t.price_obs), spi, ["countryiso3", "month"], "left")
    s = Series(("countryiso3", "commodity_group"), "month")
    return correlation.lagged_correlation(correlation.lag_series(rows, s, "usdprice", "spi"), s, "usdprice", "spi", 12)


@query("d9_lagged_correlation", "countryiso3 commodity_group lag n corr:5", "SELECT * FROM lag_corrs")
def lagged_correlation(t):
    return _lag_scan(t)


@query("d9_strongest_lag", "countryiso3 commodity_group lag corr:5", """
SELECT countryiso3, commodity_group, lag, corr FROM lag_corrs WHERE corr IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY countryiso3, commodity_group ORDER BY round(abs(corr), 9) DESC, lag) = 1""")
def strongest_lag(t):
    return correlation.strongest_lag(_lag_scan(t), ["countryiso3", "commodity_group"])


_MACRO = ["energy_index", "food_index", "fertilizer_index", "usd_etb", "fao_index"]
_MACRO_SQL = """(SELECT coalesce(m.date, e.date, f.date) AS date, energy_index, food_index, fertilizer_index, usd_etb, fao_index
FROM macro_index m FULL JOIN exchange_months e ON e.date = m.date FULL JOIN fao_months f ON f.date = coalesce(m.date, e.date)) q"""


@query("d10_correlation_matrix", "x y n corr:5", "\nUNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, count(CASE WHEN {a} IS NOT NULL THEN {b} END) AS n, {guarded_corr(a, b)} AS corr FROM {_MACRO_SQL}"
    for i, a in enumerate(_MACRO) for b in _MACRO[i + 1:]))
def correlation_matrix(t):
    wide = panel.outer_join_all([t.macro_index, t.exchange_months, t.fao_months], ["date"])
    return correlation.corr_matrix(wide, _MACRO)


cte("cell_change", """
SELECT *, CASE WHEN countryiso3 IS NOT NULL AND lag(f) OVER w <> 0 THEN f / lag(f) OVER w - 1 END AS inflation_rate FROM (
 SELECT *, last_value(per_unit_price IGNORE NULLS) OVER (PARTITION BY cell_id, countryiso3 ORDER BY month
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM cell_panel) x
WINDOW w AS (PARTITION BY cell_id, countryiso3 ORDER BY month)""")
_BLOCK = "\nUNION ALL ".join(
    f"SELECT '{a}' AS feature, '{b}' AS target, count(CASE WHEN {a} IS NOT NULL THEN {b} END) AS n, {guarded_corr(a, b)} AS corr FROM cell_change"
    for a in ("precipitation", "n_markets") for b in ("inflation_rate", "per_unit_price"))


def _cell_change(t):
    return series.percent_change(cell_panel(t), Series(("cell_id", "countryiso3"), "month"), "per_unit_price", "inflation_rate")


@query("d10_feature_block", "feature target n corr:4", _BLOCK)
def feature_block(t):
    rows = _cell_change(t).withColumn("n_markets", F.col("n_markets").cast("double"))
    return correlation.corr_block(rows, ["precipitation", "n_markets"], ["inflation_rate", "per_unit_price"])


@query("d11_best_scale_negative", "commodity_group scale corr:5", """
SELECT commodity_group, scale, corr FROM pooled_corr WHERE corr IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY commodity_group ORDER BY corr, scale) = 1""")
def best_scale_negative(t):
    rows = flows.price_index_rows(flows.monthly_usd_prices(t.price_obs), flows.country_index(t.grid_precip, t.grid_layers))
    corrs = correlation.grouped_corr(rows, ["commodity_group", "scale"], "usdprice", "spi")
    return correlation.best_scale(corrs, ["commodity_group"])


@query("d11_best_scale_absolute", "countryiso3 commodity_group scale corr:5", """
SELECT countryiso3, commodity_group, scale, corr FROM national_corr WHERE corr IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY countryiso3, commodity_group ORDER BY abs(corr) DESC, scale) = 1""")
def best_scale_absolute(t):
    rows = flows.price_index_rows(flows.national_medians(t.price_obs), flows.country_index(t.grid_precip, t.grid_layers))
    corrs = correlation.grouped_corr(rows, ["countryiso3", "commodity_group", "scale"], "usdprice", "spi", 21)
    return correlation.best_scale(corrs, ["countryiso3", "commodity_group"], mode="abs")


@query("d11_best_phase_scales", "commodity_group best_drought_scale drought_corr:5 best_flood_scale flood_corr:5", """
SELECT commodity_group, d.scale AS best_drought_scale, d.corr_drought AS drought_corr, f.scale AS best_flood_scale, f.corr_flood AS flood_corr
FROM (SELECT * FROM split_corr QUALIFY row_number() OVER (PARTITION BY commodity_group ORDER BY coalesce(abs(corr_drought), 0) DESC, scale) = 1) d
JOIN (SELECT * FROM split_corr QUALIFY row_number() OVER (PARTITION BY commodity_group ORDER BY coalesce(abs(corr_flood), 0) DESC, scale) = 1) f
USING (commodity_group)""")
def best_phase_scales(t):
    return correlation.best_phase_scales(flows.split_correlations(t.price_obs, t.grid_precip, t.grid_layers), ["commodity_group"])


@query("d12_unit_counts", "commodity unit n mean_price:4",
       "SELECT commodity, unit, count(*) AS n, avg(usdprice) AS mean_price FROM price_obs GROUP BY commodity, unit")
def unit_counts(t):
    return summary.value_counts(t.price_obs, ["commodity", "unit"], "usdprice")


@query("d13_country_extent", "countryiso3 n_rows first_date:d last_date:d n_market_id n_commodity n_admin2", """
SELECT countryiso3, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT market_id) AS n_market_id,
       count(DISTINCT commodity) AS n_commodity, count(DISTINCT admin2) AS n_admin2 FROM price_obs GROUP BY countryiso3""")
def country_extent(t):
    return summary.extent_by(t.price_obs, ["countryiso3"], "date", ["market_id", "commodity", "admin2"])


@query("d13_market_commodity_counts", "countryiso3 market_id commodity n_rows",
       "SELECT countryiso3, market_id, commodity, count(*) AS n_rows FROM price_obs GROUP BY ALL")
def market_commodity_counts(t):
    return summary.extent_by(t.price_obs, ["countryiso3", "market_id", "commodity"], "date", [])


@query("d14_cell_month_means", "cell_id countryiso3 month:d per_unit_price:5 n_markets", "SELECT * FROM cell_price")
def cell_month_means(t):
    return cell_panel(t).filter("countryiso3 IS NOT NULL")


cte("rain_flag", """
SELECT iy, ix, time AS month, precip, precip_anomaly, CASE WHEN precip_anomaly IS NOT NULL THEN CAST(precip_anomaly < -1 AS INT) END AS is_drought
FROM (SELECT *, (precip - avg(precip) OVER w) / nullif(stddev_samp(precip) OVER w, 0) AS precip_anomaly FROM grid_precip
      WINDOW w AS (PARTITION BY iy, ix, month(time))) x""")
cte("drought_prices", """
SELECT countryiso3, month, is_drought, precip_anomaly, commodity_group, price_per_kg,
       CASE WHEN lag(price_per_kg) OVER w <> 0 THEN price_per_kg / lag(price_per_kg) OVER w - 1 END AS inflation_rate
FROM (SELECT countryiso3, month, commodity_group, price_per_kg FROM monthly_price WHERE price_per_kg IS NOT NULL) p
LEFT JOIN (SELECT n_name AS countryiso3, month, is_drought, precip_anomaly FROM rain_flag JOIN nation ON n_nationkey = iy * 5 + ix) r USING (countryiso3, month)
WINDOW w AS (PARTITION BY countryiso3, commodity_group ORDER BY month)""")


def drought_prices(t):
    from granary.operators import spatial
    rain = grids.monthly_anomaly(spatial.enrich_locations(t.grid_precip, t.grid_layers, {0: "countryiso3"}), "precip")
    prices = flows.monthly_prices(t.price_obs).dropna(subset=["price_per_kg"])
    prices = series.percent_change(prices, Series(("countryiso3", "commodity_group"), "month"), "price_per_kg", "inflation_rate")
    return panel.join_on(prices, rain.select("countryiso3", F.col("time").alias("month"), "is_drought", "precip_anomaly"),
                         ["countryiso3", "month"], "left")


@query("d14_drought_impact", "is_drought inflation_mean:5 inflation_std:5 inflation_count price_mean:5 price_median:5", """
SELECT is_drought, avg(inflation_rate) AS inflation_mean, stddev_samp(inflation_rate) AS inflation_std, count(inflation_rate) AS inflation_count,
       avg(price_per_kg) AS price_mean, median(price_per_kg) AS price_median FROM drought_prices WHERE is_drought IS NOT NULL GROUP BY is_drought""")
def drought_impact(t):
    return summary.drought_impact(drought_prices(t), "is_drought", "inflation_rate", "price_per_kg")


_DESCRIBE = """count(price) AS count, avg(price) AS mean, stddev_samp(price) AS std, min(price) AS min, quantile_cont(price, 0.25) AS q25,
       quantile_cont(price, 0.5) AS q50, quantile_cont(price, 0.75) AS q75, max(price) AS max"""
_SHAPE = "count mean:4 std:4 min:5 q25:5 q50:5 q75:5 max:5"


@query("d15_describe", f"commodity {_SHAPE}",
       f"SELECT commodity, {_DESCRIBE} FROM (SELECT commodity, usdprice AS price FROM price_obs) p GROUP BY commodity")
def describe(t):
    return summary.describe_by(t.price_obs, ["commodity"], "usdprice")


cte("series_periods", """
SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY month) <= 16 THEN 'early' ELSE 'rest' END AS period FROM series_months""")


@query("d15_period_describe", f"series_id period {_SHAPE}",
       f"SELECT series_id, period, {_DESCRIBE} FROM series_periods GROUP BY series_id, period")
def period_describe(t):
    return summary.period_describe(t.series_months, Series(("series_id",)), "price")


@query("d15_early_versus_rest", "series_id mean_early:5 mean_rest:5 mean_diff:5 alert", """
SELECT *, abs(mean_diff) > 0.5 AS alert FROM (SELECT *, mean_early - mean_rest AS mean_diff FROM (
 SELECT series_id, avg(ln(price)) FILTER (WHERE period = 'early') AS mean_early, avg(ln(price)) FILTER (WHERE period = 'rest') AS mean_rest
 FROM series_periods GROUP BY series_id) a) b""")
def early_versus_rest(t):
    logs = t.series_months.withColumn("log_price", F.ln("price"))
    return summary.early_versus_rest(logs, Series(("series_id",)), "log_price")


_KINDS = {"extreme": "spi <= -2", "severe": "spi > -2 AND spi <= -1.5", "moderate": "spi > -1.5 AND spi <= -1"}


@query("d16_index_summary", "scale first_month:d last_month:d lon_min:6 lon_max:6 lat_min:6 lat_max:6 n_valid n_missing mean:5 std:5 min:5 max:5 "
       "n_extreme n_severe n_moderate pct_extreme:4 pct_severe:4 pct_moderate:4",
       "SELECT scale, min(time) AS first_month, max(time) AS last_month, min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, "
       "max(lat) AS lat_max, count(spi) AS n_valid, count(*) FILTER (WHERE spi IS NULL) AS n_missing, avg(spi) AS mean, stddev_pop(spi) AS std, "
       "min(spi) AS min, max(spi) AS max, " + ", ".join(
           f"count(*) FILTER (WHERE {c}) AS n_{k}, 100.0 * count(*) FILTER (WHERE {c}) / nullif(count(spi), 0) AS pct_{k}" for k, c in _KINDS.items())
       + " FROM spi_rows GROUP BY scale")
def index_summary(t):
    return index.spi_summary(index.spi(t.grid_precip))


@query("d17_distinct_markets", "countryiso3 admin1 market_id latitude longitude",
       "SELECT DISTINCT countryiso3, admin1, market_id, latitude, longitude FROM price_obs")
def distinct_markets(t):
    return t.price_obs.select("countryiso3", "admin1", "market_id", "latitude", "longitude").dropDuplicates()


@query("d18_first_values", "countryiso3 month:d usdprice unit admin2", """
SELECT countryiso3, month, arg_min(usdprice, k) FILTER (WHERE usdprice IS NOT NULL) AS usdprice,
       arg_min(unit, k) FILTER (WHERE unit IS NOT NULL) AS unit, arg_min(admin2, k) FILTER (WHERE admin2 IS NOT NULL) AS admin2
FROM (SELECT *, date_trunc('month', date) AS month, {'a': date, 'b': market_id, 'c': commodity, 'd': coalesce(unit, ''), 'e': coalesce(usdprice, 0)} AS k
      FROM price_obs) x GROUP BY countryiso3, month""")
def first_values(t):
    rows = series.with_month(t.price_obs).withColumns({"u": F.coalesce("unit", F.lit("")), "v": F.coalesce("usdprice", F.lit(0.0))})
    return panel.first_values(rows, ["countryiso3", "month"], ["date", "market_id", "commodity", "u", "v"], ["usdprice", "unit", "admin2"])


@query("d19_missing_counts", "countryiso3 n_rows missing_admin2 missing_latitude missing_unit missing_usdprice", """
SELECT countryiso3, count(*) AS n_rows, count(*) - count(admin2) AS missing_admin2, count(*) - count(latitude) AS missing_latitude,
       count(*) - count(unit) AS missing_unit, count(*) - count(usdprice) AS missing_usdprice FROM price_obs GROUP BY countryiso3""")
def missing_counts(t):
    return summary.missing_counts(t.price_obs, ["admin2", "latitude", "unit", "usdprice"], ["countryiso3"])


@query("d19_missing_coordinates", "market_id n", """
SELECT market_id, count(*) AS n FROM price_obs WHERE latitude IS NULL OR longitude IS NULL GROUP BY market_id""")
def missing_coordinates(t):
    return summary.rows_missing_any(t.price_obs, ["latitude", "longitude"]).groupBy("market_id").agg(F.count(F.lit(1)).alias("n"))


@query("d19_gaps_before_and_after", "series_id n_rows missing_price missing_filled", """
SELECT series_id, count(*) AS n_rows, count(*) - count(price) AS missing_price, count(*) - count(filled) AS missing_filled
FROM series_filled GROUP BY series_id""")
def gaps_before_and_after(t):
    s = Series(("series_id",))
    filled = series.interpolate(series.as_monthly(t.regular_series, s), s, "price", "filled")
    return summary.missing_counts(filled, ["price", "filled"], ["series_id"])


@query("d20_well_observed", "market_id month:d per_unit_price:5", """
SELECT market_id, month, per_unit_price FROM market_month WHERE market_id IN
 (SELECT market_id FROM market_month GROUP BY market_id HAVING count(per_unit_price) >= 20)""")
def well_observed(t):
    return summary.well_observed(flows.market_inflation(t.price_obs), ["market_id"], "per_unit_price")


@query("d21_profile", "first_year last_year n_countries n_records name", """
SELECT *, concat('food_prices_', CASE WHEN first_year = last_year THEN CAST(first_year AS VARCHAR) ELSE concat(first_year, '-', last_year) END,
  '_', n_countries, 'countries_', n_records, 'records') AS name FROM (
 SELECT min(extract(year FROM date)) AS first_year, max(extract(year FROM date)) AS last_year, count(DISTINCT countryiso3) AS n_countries,
        count(*) AS n_records FROM price_obs) x""")
def profile(t):
    return summary.profile(t.price_obs)


def _histogram_sql(col, bins, table, keys=""):
    part = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}bin, count(*) AS n, min(lo + bin * ((hi - lo) / {bins})) AS bin_start FROM (
 SELECT {lead}lo, hi, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) * {bins} / (hi - lo)), {bins - 1}) END AS INT) AS bin FROM (
  SELECT {lead}{col} AS x, min({col}) {part} AS lo, max({col}) {part} AS hi FROM {table}) a WHERE x IS NOT NULL) b GROUP BY {lead}bin, lo, hi"""


@query("d22_price_histogram", "bin n bin_start:5", _histogram_sql("usdprice", 10, "price_obs"))
def price_histogram(t):
    return summary.histogram(t.price_obs, "usdprice", 10)


@query("d22_residual_histogram", "split bin n bin_start:4",
       _histogram_sql("(actual - predicted)", 50, "predictions", "split"))
def residual_histogram(t):
    return summary.histogram(summary.residuals(t.predictions), "residual", 50, ["split"])


@query("d23_mode", "countryiso3 admin2 n", """
SELECT countryiso3, admin2, n FROM (SELECT countryiso3, admin2, count(*) AS n FROM price_obs WHERE admin2 IS NOT NULL GROUP BY ALL) x
QUALIFY row_number() OVER (PARTITION BY countryiso3 ORDER BY n DESC, admin2) = 1""")
def mode(t):
    return summary.mode_of(t.price_obs, "admin2", ["countryiso3"])


# Labels from a column of the data stand in for the clustering, which no two libraries
# reproduce alike.
cte("market_label", "SELECT s_suppkey AS market_id, CAST(floor(s_acctbal / 1000) AS INT) AS cluster FROM supplier")


def market_labels(t):
    return t.supplier.select(F.col("s_suppkey").alias("market_id"), F.floor(F.col("s_acctbal") / 1000).cast("int").alias("cluster"))


@query("d24_cluster_statistics", "cluster n_markets mean_inflation:4 std_inflation:4 max_spike:5 min_drop:5 volatility:4", """
SELECT cluster, count(*) AS n_markets, avg(m) AS mean_inflation, avg(s) AS std_inflation, max(hi) AS max_spike, min(lo) AS min_drop,
       stddev_samp(s) AS volatility
FROM (SELECT market_id, avg(inflation_rate) AS m, stddev_samp(inflation_rate) AS s, max(inflation_rate) AS hi, min(inflation_rate) AS lo
      FROM market_inflation GROUP BY market_id) x JOIN market_label USING (market_id) GROUP BY cluster""")
def cluster_statistics(t):
    return clusters.cluster_statistics(flows.market_inflation(t.price_obs), market_labels(t), "market_id", "inflation_rate")


@query("d24_cluster_mean_series", "cluster month:d cluster_mean:4", """
SELECT cluster, month, avg(inflation_rate) AS cluster_mean FROM market_inflation JOIN market_label USING (market_id) GROUP BY cluster, month""")
def cluster_mean_series(t):
    return clusters.cluster_mean_series(flows.market_inflation(t.price_obs), market_labels(t), "market_id", "month", "inflation_rate")


@query("d10_series_correlation", "cluster market_id n corr:4", f"""
SELECT cluster, market_id, count(CASE WHEN inflation_rate IS NOT NULL THEN cluster_mean END) AS n,
       {guarded_corr('inflation_rate', 'cluster_mean')} AS corr
FROM market_inflation JOIN market_label USING (market_id)
JOIN (SELECT cluster, month, avg(inflation_rate) AS cluster_mean FROM market_inflation JOIN market_label USING (market_id)
      GROUP BY cluster, month) m USING (cluster, month)
GROUP BY cluster, market_id""")
def series_correlation(t):
    return clusters.cluster_correlation(flows.market_inflation(t.price_obs), market_labels(t), "market_id", "month", "inflation_rate")


@query("d25_cluster_composition", "cluster countryiso3 n share:6", """
SELECT cluster, countryiso3, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY cluster) AS share
FROM market_label LEFT JOIN (SELECT DISTINCT market_id, countryiso3 FROM price_obs) m USING (market_id) GROUP BY cluster, countryiso3""")
def cluster_composition(t):
    return clusters.composition(clusters.membership(market_labels(t), t.price_obs, "market_id", ["countryiso3"]))


cte("t_moments", """
SELECT commodity_group, n1, n0, mean1, mean0,
       (mean1 - mean0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) AS t
FROM (SELECT commodity_group, count(a) AS n1, count(b) AS n0, avg(a) AS mean1, avg(b) AS mean0, var_samp(a) AS v1, var_samp(b) AS v0
      FROM (SELECT commodity_group, CASE WHEN is_drought = 1 THEN inflation_rate END AS a,
                   CASE WHEN is_drought = 0 THEN inflation_rate END AS b FROM drought_prices) x GROUP BY commodity_group) m""")


@query("d26_two_sample_t", "commodity_group n1 n0 mean1:5 mean0:5 t:4 p:4 significant", f"""
SELECT *, p < 0.05 AS significant FROM (SELECT *, {t_pvalue('t', '(n1 + n0 - 2)')} AS p FROM t_moments) x""")
def two_sample_t(t):
    return summary.two_sample_t(drought_prices(t), "is_drought", "inflation_rate", ["commodity_group"])


@query("d27_rain_anomaly", "iy ix month:d precip:4 precip_anomaly:4 is_drought", "SELECT * FROM rain_flag")
def rain_anomaly(t):
    return grids.monthly_anomaly(t.grid_precip, "precip").withColumnRenamed("time", "month")


@query("d28_grid_resolution", "axis step:5", """
SELECT axis, arg_min(step, {'n': -n, 's': step}) AS step FROM (
 SELECT axis, round(step, 6) AS step, count(*) AS n FROM (
  SELECT axis, place - lag(place) OVER (PARTITION BY axis ORDER BY place) AS step FROM (
   SELECT DISTINCT 'lat' AS axis, lat AS place FROM shop_points UNION SELECT DISTINCT 'lon', lon FROM shop_points) a) b
 WHERE step IS NOT NULL GROUP BY axis, round(step, 6)) c GROUP BY axis""")
def grid_resolution(t):
    return grids.grid_resolution(t.shop_points)
