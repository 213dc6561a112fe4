"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import dates, names, numeric
from granary.operators import grids, panel, series, summary
from granary.operators import index
from granary.plans.check_sql import (
    MONTH, WEIGHT_FIRST_DIGITS, WEIGHT_FIRST_NUMBER, WEIGHT_KG_LITRE, any_of, family,
)
from granary.plans.registry import query
from granary.sources import tables


@query("b1_month_truncation", "market_id commodity month:d n",
       f"SELECT market_id, commodity, {MONTH.format('date')} AS month, count(*) AS n FROM price_obs GROUP BY ALL")
def month_truncation(t):
    return series.with_month(t.price_obs).groupBy("market_id", "commodity", "month").agg(F.count(F.lit(1)).alias("n"))


def _weights(t, mode):
    weight = names.unit_weight(F.col("unit"), mode).cast("double")
    return t.price_obs.groupBy("unit", weight.alias("weight")).agg(F.count(F.lit(1)).alias("n"))


def _weights_sql(expr):
    return f"SELECT unit, CAST({expr} AS DOUBLE) AS weight, count(*) AS n FROM price_obs GROUP BY ALL"


@query("b2_unit_first_number", "unit weight:6 n", _weights_sql(WEIGHT_FIRST_NUMBER))
def unit_first_number(t):
    return _weights(t, "first_number")


@query("b3_unit_kg_or_litre", "unit weight:6 n", _weights_sql(WEIGHT_KG_LITRE))
def unit_kg_or_litre(t):
    return _weights(t, "kg_or_litre")


@query("b4_unit_first_digits", "unit weight:6 n", _weights_sql(WEIGHT_FIRST_DIGITS))
def unit_first_digits(t):
    return _weights(t, "first_digits")


@query("b5_sack_prices", "market_id date:d commodity unit usdprice:6", """
SELECT market_id, date, commodity, CASE WHEN unit = '100 KG' THEN 'KG' ELSE unit END AS unit,
       CASE WHEN unit = '100 KG' THEN usdprice / 100 ELSE usdprice END AS usdprice FROM price_obs""")
def sack_prices(t):
    return panel.normalise_sacks(t.price_obs)


@query("b6_price_per_kg", "market_id date:d commodity unit price_per_kg:6",
       f"SELECT market_id, date, commodity, unit, usdprice / {WEIGHT_FIRST_NUMBER} AS price_per_kg FROM price_obs")
def price_per_kg(t):
    return panel.price_per_kg(t.price_obs)


@query("b7_positive_weight", "market_id date:d commodity unit price_per_kg:6", f"""
SELECT market_id, date, commodity, unit, usdprice / w AS price_per_kg
FROM (SELECT *, {WEIGHT_KG_LITRE} AS w FROM price_obs) x WHERE w > 0""")
def positive_weight(t):
    return panel.positive_weight(panel.price_per_kg(t.price_obs, "kg_or_litre"))


@query("b8_target_commodities", "market_id date:d commodity usdprice:6",
       f"SELECT market_id, date, commodity, usdprice FROM price_obs WHERE {any_of('commodity', names.STAPLES)}")
def target_commodities(t):
    return panel.only_commodities(t.price_obs, names.STAPLES)


@query("b9_commodity_groups", "commodity commodity_group any_case n", f"""
SELECT commodity, {family('commodity', names.STAPLES_AND_TEFF)} AS commodity_group,
       {family('commodity', names.NATIONAL_STAPLES, True)} AS any_case, count(*) AS n FROM price_obs GROUP BY ALL""")
def commodity_groups(t):
    any_case = names.commodity_group(F.col("commodity"), names.NATIONAL_STAPLES, True).alias("any_case")
    return panel.group_commodities(t.price_obs, names.STAPLES_AND_TEFF).groupBy(
        "commodity", "commodity_group", any_case).agg(F.count(F.lit(1)).alias("n"))


@query("b10_without_milling", "commodity n",
       "SELECT commodity, count(*) AS n FROM price_obs WHERE lower(commodity) NOT LIKE '%milling cost%' GROUP BY commodity")
def without_milling(t):
    return panel.without(t.price_obs, names.NOT_FOOD).groupBy("commodity").agg(F.count(F.lit(1)).alias("n"))


@query("b11_one_commodity", "how commodity n", """
SELECT 'search' AS how, commodity, count(*) AS n FROM price_obs WHERE lower(commodity) LIKE '%sorghum%' GROUP BY commodity
UNION ALL SELECT 'exact', commodity, count(*) FROM price_obs WHERE commodity = 'Sorghum (red)' GROUP BY commodity""")
def one_commodity(t):
    found = t.price_obs.filter(names.matches(F.col("commodity"), "sorghum")).withColumn("how", F.lit("search"))
    exact = t.price_obs.filter(F.col("commodity") == "Sorghum (red)").withColumn("how", F.lit("exact"))
    return found.unionByName(exact).groupBy("how", "commodity").agg(F.count(F.lit(1)).alias("n"))


@query("b12_country_filter", "countryiso3 market_id date:d commodity usdprice:6", """
SELECT countryiso3, market_id, date, commodity, usdprice FROM price_obs WHERE countryiso3 = 'NATION_7'""")
def country_filter(t):
    return t.price_obs.filter(F.col("countryiso3") == "NATION_7")


@query("b13_clip_grid", "lat:6 lon:6 time:d precip:4", """
SELECT lat, lon, time, precip FROM grid_precip WHERE lat BETWEEN -14.975 AND -14.825 AND lon BETWEEN 25 AND 25.16
AND time BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def clip_grid(t):
    return grids.clip_grid(t.grid_precip, lat_min=-14.975, lat_max=-14.825, lon_min=25.0, lon_max=25.16,
                           year_start=1996, year_end=1999)


@query("b14_grid_names", "lat:6 lon:6 time:d precip:4", "SELECT lat, lon, time, precip FROM grid_precip")
def grid_names(t):
    theirs = t.grid_precip.withColumnsRenamed({"lat": "latitude", "lon": "longitude", "precip": "precipitation"})
    return tables.normalise_grid_columns(theirs)


@query("b15_logs", "market_id date:d commodity log_eps:6 log_plain:6", """
SELECT market_id, date, commodity, ln(usdprice + 1e-6) AS log_eps, ln(usdprice) AS log_plain FROM price_obs""")
def logs(t):
    return t.price_obs.withColumns({
        "log_eps": numeric.log_of(F.col("usdprice")), "log_plain": numeric.log_of(F.col("usdprice"), 0)})


def _index_rows(t):
    return index.spi(t.grid_precip)


@query("b16_value_split", "iy ix time:d scale spi_drought:5 spi_flood:5", """
SELECT iy, ix, time, scale, CASE WHEN spi < -0.5 THEN spi ELSE 0 END AS spi_drought,
       CASE WHEN spi > 0.5 THEN spi ELSE 0 END AS spi_flood FROM spi_rows""")
def value_split(t):
    return _index_rows(t).withColumns({
        "spi_drought": numeric.below(F.col("spi"), -0.5), "spi_flood": numeric.above(F.col("spi"), 0.5)})


@query("b17_sign_split", "iy ix time:d scale drought flood drought_severe flood_severe drought_spi:5 flood_spi:5 "
       "log_drought_spi:4 log_flood_spi:5", """
SELECT iy, ix, time, scale, CASE WHEN spi < 0 THEN 1 ELSE 0 END AS drought, CASE WHEN spi > 0 THEN 1 ELSE 0 END AS flood,
       CASE WHEN spi < 0.5 THEN 1 ELSE 0 END AS drought_severe, CASE WHEN spi > 0.5 THEN 1 ELSE 0 END AS flood_severe,
       CASE WHEN spi < 0 THEN spi ELSE 0 END AS drought_spi, CASE WHEN spi > 0 THEN spi ELSE 0 END AS flood_spi,
       CASE WHEN spi < 0 THEN CASE WHEN spi + 1 > 0 THEN ln(spi + 1) END ELSE 0.0 END AS log_drought_spi,
       CASE WHEN spi > 0 THEN ln(spi + 1) ELSE 0.0 END AS log_flood_spi FROM spi_rows""")
def sign_split(t):
    spi = F.col("spi")
    rows = _index_rows(t).withColumns({
        "drought": numeric.flag_below(spi, 0.0), "flood": numeric.flag_above(spi, 0.0),
        "drought_severe": numeric.flag_below(spi, 0.5), "flood_severe": numeric.flag_above(spi, 0.5),
        "drought_spi": numeric.below(spi, 0.0), "flood_spi": numeric.above(spi, 0.0)})
    return rows.withColumns({
        "log_drought_spi": numeric.log_of(F.col("drought_spi"), 1.0), "log_flood_spi": numeric.log_of(F.col("flood_spi"), 1.0)})


@query("b18_index_class", "scale class n", """
SELECT scale, CASE WHEN spi <= -2 THEN 'extreme drought' WHEN spi <= -1.5 THEN 'severe drought'
  WHEN spi <= -1 THEN 'moderate drought' WHEN spi < 1 THEN 'normal' WHEN spi < 1.5 THEN 'moderate wet'
  WHEN spi < 2 THEN 'severe wet' WHEN spi IS NOT NULL THEN 'extreme wet' END AS class, count(*) AS n FROM spi_rows GROUP BY ALL""")
def index_class(t):
    return _index_rows(t).groupBy("scale", numeric.index_class(F.col("spi")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("b19_drop_missing", "rule n", """
SELECT 'any' AS rule, count(*) AS n FROM price_obs
 WHERE admin2 IS NOT NULL AND latitude IS NOT NULL AND unit IS NOT NULL AND usdprice IS NOT NULL
UNION ALL SELECT 'some', count(*) FROM price_obs WHERE usdprice IS NOT NULL AND unit IS NOT NULL
UNION ALL SELECT 'all', count(*) FROM price_obs WHERE usdprice IS NOT NULL OR unit IS NOT NULL""")
def drop_missing(t):
    p = t.price_obs
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    some = ["usdprice", "unit"]
    return count(p.dropna(), "any").unionByName(count(p.dropna(subset=some), "some")).unionByName(
        count(p.dropna("all", subset=some), "all"))


@query("b20_date_parsing", "text date:d n", """
SELECT text, CASE WHEN regexp_matches(text, '^\\d{4}M\\d\\d$') THEN CAST(concat(substr(text, 1, 4), '-', substr(text, 6, 2), '-01') AS DATE)
  WHEN regexp_matches(text, '^\\d{4}-\\d\\d-\\d\\d$') THEN CAST(text AS DATE)
  WHEN regexp_matches(text, '^\\d{4}-\\d\\d$') THEN CAST(concat(text, '-01') AS DATE) END AS date, count(*) AS n
FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%YM%m') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN 2 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%d of %m') END AS text FROM orders) x GROUP BY ALL""")
def date_parsing(t):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    text = F.when(k == 0, F.date_format(d, "yyyy'M'MM")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(
        k == 2, F.date_format(d, "yyyy-MM")).otherwise(F.date_format(d, "dd 'of' MM"))
    return t.orders.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "date", dates.parse_date(F.col("text")))


@query("b21_numeric_coercion", "rn energy_index:6 food_index:6", """
SELECT rn, TRY_CAST(c2 AS DOUBLE) AS energy_index, TRY_CAST(c6 AS DOUBLE) AS food_index FROM index_sheet""")
def numeric_coercion(t):
    return t.index_sheet.select("rn", numeric.to_number(F.col("c2")).alias("energy_index"),
                                numeric.to_number(F.col("c6")).alias("food_index"))


@query("b22_select_rename", "country_iso admin2 market date:d price:6", """
SELECT countryiso3 AS country_iso, admin2, market, date, usdprice AS price FROM price_obs""")
def select_rename(t):
    return t.price_obs.select("countryiso3", "admin2", "market", "date", "usdprice").withColumnsRenamed(
        {"countryiso3": "country_iso", "usdprice": "price"})


@query("b23_calendar_features", "series_id month:d month_num year_num", """
SELECT series_id, month, extract(month FROM month) AS month_num, extract(year FROM month) AS year_num FROM series_months""")
def calendar_features(t):
    return series.calendar_features(t.series_months, "month")


@query("b24_plot_sample", "l_orderkey l_linenumber l_discount:6 l_tax:6", """
SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE abs(l_discount) < 0.09 AND abs(l_tax) < 0.07
ORDER BY md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
  CAST(l_suppkey AS VARCHAR))), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5000""")
def plot_sample(t):
    return summary.plot_sample(t.lineitem, {"l_discount": 0.09, "l_tax": 0.07}, 5000,
                               ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("b25_relabel", "o_orderkey status", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS status FROM orders""")
def relabel(t):
    return t.orders.select("o_orderkey", names.relabel(F.col("o_orderstatus"), {"F": "Filled", "O": "Open"}).alias("status"))


@query("b26_back_transform", "series_id month:d price:6", "SELECT series_id, month, price FROM series_months")
def back_transform(t):
    return t.series_months.withColumn("price", F.exp(numeric.log_of(F.col("price"), 0)))


@query("b27_zero_for_missing", "iy ix time:d scale spi:5", "SELECT iy, ix, time, scale, coalesce(spi, 0) AS spi FROM spi_rows")
def zero_for_missing(t):
    return _index_rows(t).withColumn("spi", numeric.zero_if_null(F.col("spi")))


@query("b28_key_safe_names", "unit commodity unit_key commodity_key", """
SELECT DISTINCT unit, commodity, replace(replace(unit, '/', '_'), ' ', '_') AS unit_key,
       replace(replace(commodity, '/', '_'), ' ', '') AS commodity_key FROM price_obs""")
def key_safe_names(t):
    return t.price_obs.select("unit", "commodity").distinct().withColumns({
        "unit_key": names.key_safe(F.col("unit")), "commodity_key": names.key_safe(F.col("commodity"), "")})


@query("b29_year_slice", "asked iy ix time:d precip:4", """
SELECT 1998 AS asked, iy, ix, time, precip FROM grid_precip WHERE extract(year FROM time) = 1998
UNION ALL SELECT 2090, iy, ix, time, precip FROM grid_precip
WHERE extract(year FROM time) = (SELECT max(extract(year FROM time)) FROM grid_precip)""")
def year_slice(t):
    one = lambda y: grids.year_slice(t.grid_precip, y).withColumn("asked", F.lit(y))
    return one(1998).unionByName(one(2090))
