"""Joins, key matching and spatial assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.cells import assign_cell
from granary.operators import correlation, grids, panel, series, spatial
from granary.operators.grids import Lattice
from granary.operators.series import Series
from granary.plans import flows
from granary.plans.check_sql import MONTH, WEIGHT_FIRST_NUMBER
from granary.plans.registry import cte, query


@query("c1_price_index_join", "countryiso3 month:d commodity_group scale price_per_kg:5 spi:5", "SELECT * FROM price_spi")
def price_index_join(t):
    return flows.price_index_rows(flows.monthly_prices(t.price_obs), flows.country_index(t.grid_precip, t.grid_layers))


@query("c2_admin2_join", "country_iso admin2 date:d commodity_group day:d price_per_kg:4 spi_6m:5",
       "SELECT * FROM admin2_price JOIN admin2_spi USING (country_iso, admin2, date)")
def admin2_join(t):
    return panel.join_on(flows.admin2_prices(t.price_obs), flows.admin2_index(t.grid_precip, t.grid_layers),
                         ["country_iso", "admin2", "date"])


@query("c3_macro_join", "countryiso3 month:d commodity_group price_per_kg:5 energy_index:6 food_index:6 fertilizer_index:6",
       "SELECT * FROM monthly_price LEFT JOIN macro_month USING (month)")
def macro_join(t):
    return panel.join_on(flows.monthly_prices(t.price_obs), flows.macro_months(t.macro_index), ["month"], "left")


@query("c4_outer_join_on_date", "date:d energy_index:6 food_index:6 fertilizer_index:6 usd_etb:6 fao_index:6", """
SELECT coalesce(m.date, e.date, f.date) AS date, energy_index, food_index, fertilizer_index, usd_etb, fao_index
FROM macro_index m FULL JOIN exchange_rate e ON e.date = m.date
FULL JOIN fao_index f ON f.date = coalesce(m.date, e.date)""")
def outer_join_on_date(t):
    return panel.outer_join_all([t.macro_index, t.exchange_rate, t.fao_index], ["date"]).orderBy("date")


# A cell edge of five degrees lets the few rainfall cells meet markets.
_SIZE = 5.0
_SQUARE = f"concat('s', CAST(CAST(floor(lat / {_SIZE}) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor(lon / {_SIZE}) AS BIGINT) AS VARCHAR))"
cte("cell_rain", f"SELECT {_SQUARE} AS cell_id, time AS month, avg(precip) AS precipitation FROM grid_precip GROUP BY ALL")
cte("cell_price", f"""
SELECT cell_id, countryiso3, month, avg(p) AS per_unit_price, count(market_id) AS n_markets
FROM (SELECT {_SQUARE} AS cell_id, countryiso3, {MONTH.format('date')} AS month, usdprice / {WEIGHT_FIRST_NUMBER} AS p, market_id
      FROM (SELECT *, latitude AS lat, longitude AS lon FROM price_obs) q
      WHERE contains(commodity, 'Sorghum') AND lat IS NOT NULL AND lon IS NOT NULL) r GROUP BY ALL""")
cte("cell_panel", "SELECT * FROM cell_rain FULL JOIN cell_price USING (cell_id, month)")


def cell_panel(t):
    from granary.operators.summary import cell_month_means
    place = lambda df, lat, lon: df.withColumn("cell_id", assign_cell(F.col(lat), F.col(lon), _SIZE))
    rain = panel.mean_by(place(t.grid_precip, "lat", "lon").withColumnRenamed("time", "month"),
                         ["cell_id", "month"], "precip", "precipitation")
    sold = t.price_obs.filter(F.contains("commodity", F.lit("Sorghum"))).dropna(subset=["latitude", "longitude"])
    sold = place(series.with_month(panel.price_per_kg(sold)), "latitude", "longitude")
    prices = cell_month_means(sold, ["cell_id", "countryiso3", "month"], "price_per_kg", "market_id", "n_markets")
    return panel.outer_join_all([rain, prices.withColumnRenamed("price_per_kg", "per_unit_price")], ["cell_id", "month"])


@query("c5_cell_outer_join", "cell_id month:d countryiso3 precipitation:4 per_unit_price:5 n_markets", "SELECT * FROM cell_panel")
def cell_outer_join(t):
    return cell_panel(t)


@query("c6_cluster_attributes", "market_id cluster market countryiso3 latitude:6 longitude:6", """
SELECT market_id, cluster, market, countryiso3, latitude, longitude FROM
 (SELECT s_suppkey AS market_id, CAST(floor(s_acctbal / 1000) AS INT) AS cluster FROM supplier) l
 LEFT JOIN (SELECT DISTINCT market_id, market, countryiso3, latitude, longitude FROM price_obs) m USING (market_id)""")
def cluster_attributes(t):
    from granary.operators.clusters import membership
    labels = t.supplier.select(F.col("s_suppkey").alias("market_id"), F.floor(F.col("s_acctbal") / 1000).cast("int").alias("cluster"))
    return membership(labels, t.price_obs, "market_id", ["market", "countryiso3", "latitude", "longitude"])


# Brute force: every point against every segment of every area.
cte("area_hits", """
SELECT point_id, s.level, s.n_nationkey, s.pos, s.name
FROM shop_points p JOIN (SELECT level, n_nationkey, pos, name, min(least(x1, x2)) AS a, max(greatest(x1, x2)) AS b,
       min(least(y1, y2)) AS c, max(greatest(y1, y2)) AS d FROM area_segments GROUP BY ALL) x
  ON lon > a AND lon < b AND lat > c AND lat < d
JOIN area_segments s ON s.level = x.level AND s.n_nationkey = x.n_nationkey AND s.pos = x.pos
GROUP BY ALL
HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) / (y2 - y1) * (x2 - x1) THEN 1 ELSE 0 END) % 2 = 1""")
cte("point_areas", """
SELECT point_id, lat, lon, """ + ", ".join(
    f"(SELECT arg_min(name, n_nationkey * 10 + pos) FROM area_hits h WHERE h.point_id = p.point_id AND level = {k}) AS {c}"
    for k, c in spatial.ADMIN_COLUMNS.items()) + " FROM shop_points p")


@query("c7_spatial_join", "point_id lat:6 lon:6 admin3", "SELECT point_id, lat, lon, admin3 FROM point_areas")
def spatial_join(t):
    return spatial.spatial_join(t.shop_points, t.layers, 3, "admin3")


@query("c8_enrich_locations", "market_id date:d commodity unit usdprice country_iso area1 area2 area3", """
SELECT market_id, date, commodity, unit, usdprice, country_iso, area1, area2, area3 FROM price_obs LEFT JOIN (
 SELECT DISTINCT CAST(-15 + (s_suppkey * 37 % 740) * 0.05 AS DOUBLE) AS latitude,
        CAST(25 + (s_suppkey * 101 % 540) * 0.05 AS DOUBLE) AS longitude, country_iso, area1, area2, area3
 FROM supplier JOIN market_areas ON market_areas.k = s_suppkey) m USING (latitude, longitude)""")
def enrich_locations(t):
    out = {0: "country_iso", 1: "area1", 2: "area2", 3: "area3"}
    return spatial.enrich_locations(t.price_obs, t.layers, out, "latitude", "longitude")


_TURN = "((lon - x1) * (y2 - y1) - (x2 - x1) * (lat - y1))"
cte("market_points", """
SELECT s_suppkey AS k, CAST(-15 + (s_suppkey * 37 % 740) * 0.05 AS DOUBLE) AS lat,
       CAST(25 + (s_suppkey * 101 % 540) * 0.05 AS DOUBLE) AS lon FROM supplier""")
cte("market_hits", f"""
SELECT k, level, n_nationkey, pos, name FROM market_points CROSS JOIN area_segments GROUP BY ALL
HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND ((y2 > y1) = ({_TURN} < 0)) THEN 1 ELSE 0 END) % 2 = 1
   AND sum(CASE WHEN {_TURN} = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)
                 AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 0""")
cte("market_areas", "SELECT k, " + ", ".join(
    f"(SELECT arg_min(name, n_nationkey * 10 + pos) FROM market_hits h WHERE h.k = p.k AND level = {k}) AS {c}"
    for k, c in {0: "country_iso", 1: "area1", 2: "area2", 3: "area3"}.items()) + " FROM market_points p")


cte("rain_lattice", """
SELECT CAST(t AS DATE) AS time, CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, g.precip
FROM (SELECT unnest(generate_series(min(time), max(time), INTERVAL 1 MONTH)) AS t FROM grid_precip) a
CROSS JOIN (SELECT unnest(range(min(iy), max(iy) + 1)) AS iy FROM grid_precip) b
CROSS JOIN (SELECT unnest(range(min(ix), max(ix) + 1)) AS ix FROM grid_precip) c
LEFT JOIN (SELECT time AS gt, iy AS gy, ix AS gx, CASE WHEN (iy * 7 + ix * 3 + month(time)) % 4 <> 0 THEN precip END AS precip
           FROM grid_precip) g ON g.gt = CAST(t AS DATE) AND g.gy = iy AND g.gx = ix""")


def rain_with_gaps(t):
    gap = (F.col("iy") * 7 + F.col("ix") * 3 + F.month("time")) % 4 == 0
    return t.grid_precip.withColumn("precip", F.when(~gap, F.col("precip")))


def _nearest_sql(limit: str) -> str:
    return f"""
SELECT m.time, m.iy, m.ix, coalesce(m.precip, (
  SELECT arg_min(v.precip, ((v.iy - m.iy) * (v.iy - m.iy) + (v.ix - m.ix) * (v.ix - m.ix)) * 10000 + v.iy * 100 + v.ix)
  FROM rain_lattice v WHERE v.time = m.time AND v.precip IS NOT NULL
   AND (v.iy - m.iy) * (v.iy - m.iy) + (v.ix - m.ix) * (v.ix - m.ix) <= {limit})) AS precip, m.precip IS NULL AS gap
FROM rain_lattice m"""


@query("c9_nearest_fill", "time:d iy ix precip:4 was_filled",
       f"SELECT time, iy, ix, precip, gap AND precip IS NOT NULL AS was_filled FROM ({_nearest_sql('1000000')}) f")
def nearest_fill(t):
    return grids.fill_nearest(grids.complete_grid(rain_with_gaps(t), "precip"), "precip")


@query("c9_nearest_fill_limited", "time:d iy ix precip:4 was_filled",
       f"SELECT time, iy, ix, precip, gap AND precip IS NOT NULL AS was_filled FROM ({_nearest_sql('1')}) f")
def nearest_fill_limited(t):
    return grids.fill_nearest(grids.complete_grid(rain_with_gaps(t), "precip"), "precip", max_radius=1)


@query("c10_key_membership", "series_id month:d price:6", """
SELECT * FROM series_months WHERE series_id IN
 (SELECT series_id FROM series_months GROUP BY series_id HAVING count(price) >= 20)""")
def key_membership(t):
    members = t.series_months.groupBy("series_id").agg(F.count("price").alias("n")).filter("n >= 20")
    return panel.keep_members(t.series_months, members, ["series_id"])


@query("c11_unit_audit", "unit weight_kg:6 n_rows defaulted no_kg not_positive", f"""
SELECT unit, w AS weight_kg, count(*) AS n_rows, w = 1 AS defaulted, NOT contains(upper(coalesce(unit, '')), 'KG') AS no_kg,
       w <= 0 AS not_positive
FROM (SELECT *, {WEIGHT_FIRST_NUMBER} AS w FROM price_obs) x GROUP BY unit, w""")
def unit_audit(t):
    return panel.unit_audit(t.price_obs)


@query("c11_defaulted_unit_users", "unit commodity", f"""
SELECT DISTINCT unit, commodity FROM price_obs WHERE unit IS NOT NULL AND {WEIGHT_FIRST_NUMBER} = 1""")
def defaulted_unit_users(t):
    return panel.defaulted_unit_users(t.price_obs)


_Q, _R = "(lon * 0.5773502691896257 - lat * 0.3333333333333333) / 0.5", "lat * 0.6666666666666666 / 0.5"


@query("c12_point_cells", "point_id square hexagon", f"""
SELECT point_id, concat('s', CAST(CAST(floor(lat / 0.5) AS BIGINT) AS VARCHAR), '_', CAST(CAST(floor(lon / 0.5) AS BIGINT) AS VARCHAR)) AS square,
       concat('h', CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS VARCHAR), '_',
              CAST(CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS VARCHAR)) AS hexagon
FROM (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM (
  SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(s, 0) AS rs FROM (
    SELECT *, -q - r AS s FROM (SELECT *, {_Q} AS q, {_R} AS r FROM shop_points) a) b) c) d""")
def point_cells(t):
    return t.shop_points.select(
        "point_id", assign_cell(F.col("lat"), F.col("lon"), 0.5).alias("square"),
        assign_cell(F.col("lat"), F.col("lon"), 0.5, "hexagon").alias("hexagon"))


@query("c13_series_alignment", "month:d price:5 spi:5", """
SELECT month, a.price, b.spi FROM
 (SELECT month, avg(price_per_kg) AS price FROM monthly_price WHERE commodity_group = 'Sorghum' GROUP BY month) a
 JOIN (SELECT month, avg(spi) AS spi FROM country_spi WHERE scale = 6 GROUP BY month) b USING (month)
WHERE price IS NOT NULL AND spi IS NOT NULL""")
def series_alignment(t):
    price = panel.mean_by(flows.monthly_prices(t.price_obs).filter("commodity_group = 'Sorghum'"), ["month"], "price_per_kg", "price")
    spi = panel.mean_by(flows.country_index(t.grid_precip, t.grid_layers, [6]), ["month"], "spi")
    return panel.join_on(price, spi, ["month"]).dropna()


_SOURCE = Lattice(-15.0, 25.0, 0.05, 5, 5)
_TARGET = Lattice(-15.0, 25.0, 0.02, 11, 11)


@query("c14_bilinear_regrid", "time:d ty tx lat:6 lon:6 precip:4", """
SELECT time, ty, tx, -15.0 + ty * 0.02 AS lat, 25.0 + tx * 0.02 AS lon,
       CASE WHEN count(precip) = max(need) THEN sum(w * precip) END AS precip
FROM (SELECT *, count(*) OVER (PARTITION BY ty, tx) AS need FROM (
  SELECT ty, tx, iy, ix, (1 - abs(ty * 0.4 - iy)) * (1 - abs(tx * 0.4 - ix)) AS w
  FROM (SELECT unnest(range(0, 11)) AS ty) a, (SELECT unnest(range(0, 11)) AS tx) b,
       (SELECT unnest(range(0, 7)) AS iy) c, (SELECT unnest(range(0, 7)) AS ix) d
  WHERE abs(ty * 0.4 - iy) < 1 AND abs(tx * 0.4 - ix) < 1) e) c
JOIN grid_precip USING (iy, ix) WHERE precip IS NOT NULL GROUP BY time, ty, tx""")
def bilinear_regrid(t):
    return grids.regrid_bilinear(t.grid_precip, _SOURCE, _TARGET, "precip")


@query("c15_land_mask", "iy ix time:d precip:4", """
SELECT iy, ix, time, precip FROM grid_precip
WHERE (iy, ix) IN (SELECT (CAST(floor(n_nationkey / 5.0) AS INT), CAST(n_nationkey % 5 AS INT)) FROM nation WHERE n_regionkey <= 2)""")
def land_mask(t):
    mask = t.nation.filter("n_regionkey <= 2").select(
        F.floor(F.col("n_nationkey") / 5).cast("int").alias("iy"), (F.col("n_nationkey") % 5).cast("int").alias("ix"))
    return grids.land_mask(t.grid_precip, mask)


@query("g1_union_all", "source n", """
SELECT 'price' AS source, count(*) AS n FROM price_obs UNION ALL SELECT 'rain', count(*) FROM grid_precip
UNION ALL SELECT 'index', count(*) FROM macro_index""")
def union_all(t):
    tag = lambda df, name: df.select(F.lit(name).alias("source"))
    rows = tag(t.price_obs, "price").unionByName(tag(t.grid_precip, "rain")).unionByName(tag(t.macro_index, "index"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("g2_key_overlap", "admin2 side", """
SELECT coalesce(a.admin2, b.admin2) AS admin2, CASE WHEN a.admin2 IS NULL THEN 'right' WHEN b.admin2 IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT DISTINCT admin2 FROM price_obs WHERE admin2 IS NOT NULL) a
FULL JOIN (SELECT DISTINCT admin2 FROM admin2_spi) b ON a.admin2 = b.admin2""")
def key_overlap(t):
    return panel.key_overlap(t.price_obs, flows.admin2_index(t.grid_precip, t.grid_layers), ["admin2"])
