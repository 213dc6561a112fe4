"""Time-series operators, orderings and top rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import correlation, index, panel, series
from granary.operators.series import Series
from granary.plans import flows
from granary.plans.aggregation_queries import _BLOCK, _cell_change
from granary.plans.registry import query

_S = Series(("series_id",))


def _dense(t):
    return series.as_monthly(t.regular_series, _S)


def _filled(t):
    return series.interpolate(_dense(t), _S, "price", "filled")


def _lags(col, lags, prefix):
    return ", ".join(f"lag({col}, {k}) OVER w AS {prefix}_{k}" for k in lags)


@query("e1_lag_rows", "country_iso admin2 commodity_group day:d price_per_kg:4 price_lag_1:4 price_lag_2:4 price_lag_3:4 price_lag_6:4", f"""
SELECT country_iso, admin2, commodity_group, day, price_per_kg, {_lags('price_per_kg', flows.ADMIN2_LAGS, 'price_lag')} FROM admin2_price
WINDOW w AS (PARTITION BY country_iso, admin2, commodity_group ORDER BY day)""")
def lag_rows(t):
    return series.lag_rows(flows.admin2_prices(t.price_obs), Series(tuple(flows.ADMIN2_KEYS), "day"), "price_per_kg",
                           flows.ADMIN2_LAGS, "price_lag")


_CALENDAR = (1, 3, 6, 7, 9, 12, 24)


@query("e2_lag_months", "series_id month:d price:5 " + " ".join(f"lag_{k}:5" for k in _CALENDAR),
       "SELECT a.series_id, a.month, a.price, " + ", ".join(f"l{k}.price AS lag_{k}" for k in _CALENDAR) + " FROM regular_series a "
       + " ".join(f"LEFT JOIN regular_series l{k} ON l{k}.series_id = a.series_id AND l{k}.month = CAST(a.month - to_months({k}) AS DATE)"
                  for k in _CALENDAR))
def lag_months(t):
    return series.lag_months(t.regular_series, _S, "price", _CALENDAR, "lag")


@query("e3_rolling", "series_id month:d roll_mean_3:5 roll_mean_6:5 roll_std_6:5", """
SELECT series_id, month, CASE WHEN count(price) OVER a = 3 THEN avg(price) OVER a END AS roll_mean_3,
       CASE WHEN count(price) OVER b = 6 THEN avg(price) OVER b END AS roll_mean_6,
       CASE WHEN count(price) OVER b = 6 THEN stddev_samp(price) OVER b END AS roll_std_6
FROM series_dense WINDOW a AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  b AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def rolling(t):
    return _dense(t).withColumns({
        "roll_mean_3": series.rolling_past(_S, "price", 3, "mean"), "roll_mean_6": series.rolling_past(_S, "price", 6, "mean"),
        "roll_std_6": series.rolling_past(_S, "price", 6, "std")})


@query("e4_changes", "market_id month:d difference:5 log_difference:5 inflation_rate:5", """
SELECT market_id, month, per_unit_price - lag(per_unit_price) OVER w AS difference,
       ln(per_unit_price) - ln(lag(per_unit_price) OVER w) AS log_difference, inflation_rate
FROM market_inflation WINDOW w AS (PARTITION BY market_id ORDER BY month)""")
def changes(t):
    s = Series(("market_id",))
    return flows.market_inflation(t.price_obs).withColumns({
        "difference": series.difference(s, "per_unit_price"), "log_difference": series.log_difference(s, "per_unit_price")})


@query("e4_cell_changes", "cell_id countryiso3 month:d per_unit_price:5 inflation_rate:5",
       "SELECT cell_id, countryiso3, month, per_unit_price, inflation_rate FROM cell_change")
def cell_changes(t):
    return _cell_change(t)


@query("e5_as_monthly", "series_id month:d price:5", "SELECT series_id, month, price FROM series_dense")
def as_monthly(t):
    return _dense(t)


@query("e6_interpolate", "series_id month:d filled:5", "SELECT series_id, month, filled FROM series_filled")
def interpolate(t):
    return _filled(t)


@query("e7_fill_both", "series_id month:d price:5", """
SELECT series_id, month, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(price IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price
FROM (SELECT series_id, month, CASE WHEN month(month) > 3 THEN price END AS price FROM series_dense) x""")
def fill_both(t):
    gaps = _dense(t).withColumn("price", F.when(F.month("month") > 3, F.col("price")))
    return series.fill_both(gaps, _S, "price")


@query("e8_accumulate", "iy ix time:d scale total:4", "SELECT iy, ix, time, scale, total FROM rain_sums_made")
def accumulate(t):
    return index.accumulate_scales(t.grid_precip, "precip", index.GENERATED_SCALES)


@query("e9_split_tail", "series_id month:d split", """
SELECT series_id, month, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY month DESC) <= 12 THEN 'test' ELSE 'train' END AS split
FROM series_months""")
def split_tail(t):
    return series.split_tail(t.series_months, _S, 12)


@query("e10_split_date", "part n mean_price:4", """
SELECT CASE WHEN date < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS part, count(*) AS n, avg(usdprice) AS mean_price
FROM price_obs GROUP BY ALL""")
def split_date(t):
    train, test = series.split_at(t.price_obs, "date", "2000-01-01")
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("usdprice").alias("mean_price"))


@query("f1_total_order", "date:d energy_index:6 food_index:6 fertilizer_index:6", "SELECT * FROM macro_index ORDER BY date")
def total_order(t):
    return t.macro_index.orderBy("date")


@query("f2_top_groups", "commodity_group total", """
SELECT commodity_group, sum(n_total) AS total FROM split_corr GROUP BY commodity_group ORDER BY total DESC, commodity_group LIMIT 4""")
def top_groups(t):
    corrs = flows.split_correlations(t.price_obs, t.grid_precip, t.grid_layers)
    return panel.top_groups(corrs, "commodity_group", "n_total", 4)


@query("f2_top_correlations", "feature target n corr:4 direction", f"""
SELECT *, CASE WHEN corr > 0 THEN 'up' ELSE 'down' END AS direction FROM ({_BLOCK}) b WHERE corr IS NOT NULL
ORDER BY abs(corr) DESC, feature, target LIMIT 10""")
def top_correlations(t):
    rows = _cell_change(t).withColumn("n_markets", F.col("n_markets").cast("double"))
    block = correlation.corr_block(rows, ["precipitation", "n_markets"], ["inflation_rate", "per_unit_price"])
    return correlation.top_correlations(block, 10)


@query("f2_most_observed", "commodity_group scale n_total corr_overall:5", """
SELECT commodity_group, scale, n_total, corr_overall FROM split_corr WHERE commodity_group IN
 (SELECT commodity_group FROM split_corr GROUP BY commodity_group ORDER BY sum(n_total) DESC, commodity_group LIMIT 4)""")
def most_observed(t):
    return correlation.most_observed(flows.split_correlations(t.price_obs, t.grid_precip, t.grid_layers))


@query("f3_best_row", "market_id month:d inflation_rate:5", """
SELECT market_id, month, inflation_rate FROM market_inflation WHERE inflation_rate IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY inflation_rate DESC, month) = 1""")
def best_row(t):
    rows = flows.market_inflation(t.price_obs).select("market_id", "month", "inflation_rate")
    return panel.best_row(rows, ["market_id"], F.col("inflation_rate"), ["month"])


@query("f4_head_and_tail", "part date:d energy_index:6", """
SELECT * FROM (SELECT 'head' AS part, date, energy_index FROM macro_index ORDER BY date LIMIT 5) a
UNION ALL SELECT * FROM (SELECT 'tail', date, energy_index FROM macro_index ORDER BY date DESC LIMIT 5) b""")
def head_and_tail(t):
    rows = t.macro_index.select("date", "energy_index")
    head = rows.orderBy("date").limit(5).withColumn("part", F.lit("head"))
    return head.unionByName(rows.orderBy(F.col("date").desc()).limit(5).withColumn("part", F.lit("tail")))


@query("f4_ranked_correlations", "commodity_group scale corr_overall:5", """
SELECT commodity_group, scale, corr_overall FROM split_corr ORDER BY corr_overall DESC, commodity_group, scale LIMIT 10""")
def ranked_correlations(t):
    corrs = flows.split_correlations(t.price_obs, t.grid_precip, t.grid_layers)
    return corrs.orderBy(F.col("corr_overall").desc(), "commodity_group", "scale").limit(10)
