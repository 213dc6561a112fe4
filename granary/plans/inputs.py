"""The engine's input tables, read from a folder of Parquet tables.

The business tables of the folder stand in for market prices, rainfall and indices. Each
view is one SQL text that reads the same in Spark and in the check engine, so both start
from the same rows; everything after it is computed twice, independently.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.numeric import nan_to_null
from granary.sources import geojson

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "price_obs": """
SELECT n_name AS countryiso3,
       concat(n_name, '-A', CAST(s_suppkey % 3 AS VARCHAR(9))) AS admin1,
       CASE WHEN s_suppkey % 17 = 0 THEN NULL
            ELSE concat(n_name, '-B', CAST(s_suppkey % 5 AS VARCHAR(9))) END AS admin2,
       s_suppkey AS market_id, s_name AS market,
       CASE WHEN s_suppkey % 13 = 0 THEN NULL
            ELSE CAST(-15 + (s_suppkey * 37 % 740) * 0.05 AS DOUBLE) END AS latitude,
       CAST(25 + (s_suppkey * 101 % 540) * 0.05 AS DOUBLE) AS longitude,
       CAST(l_shipdate AS DATE) AS date,
       commodity, unit,
       CASE WHEN l_linenumber = 7 THEN NULL
            ELSE l_extendedprice / l_quantity END AS usdprice
FROM {lineitem}
JOIN (SELECT p_partkey,
       CASE split_part(p_name, ' ', 2)
            WHEN 'anvil' THEN 'Milling cost (Maize)'
            ELSE concat(CASE split_part(p_name, ' ', 2)
                 WHEN 'ring' THEN 'Maize' WHEN 'bolt' THEN 'Sorghum'
                 WHEN 'gear' THEN 'Wheat' WHEN 'gizmo' THEN 'Rice'
                 WHEN 'plate' THEN 'Beans' WHEN 'rod' THEN 'Teff'
                 ELSE 'Oil' END, ' (', split_part(p_name, ' ', 1), ')') END AS commodity,
       CASE p_size % 8 WHEN 0 THEN 'KG' WHEN 1 THEN '100 KG' WHEN 2 THEN '50 KG'
            WHEN 3 THEN '3.5 KG' WHEN 4 THEN 'L' WHEN 5 THEN '500 ML'
            WHEN 6 THEN 'LCU/3.5kg' ELSE NULL END AS unit
      FROM {part}) goods ON p_partkey = l_partkey
JOIN {supplier} ON s_suppkey = l_suppkey
JOIN {nation} ON n_nationkey = s_nationkey""",
    "macro_index": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
       avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) / 1000 AS energy_index,
       avg(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice END) / 1000 AS food_index,
       avg(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice END) / 1000 AS fertilizer_index
FROM {orders}
GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "grid_precip": """
SELECT CAST(floor(c_nationkey / 5.0) AS INT) AS iy,
       CAST(c_nationkey % 5 AS INT) AS ix,
       CAST(-15 + floor(c_nationkey / 5.0) * 0.05 AS DOUBLE) AS lat,
       CAST(25 + (c_nationkey % 5) * 0.05 AS DOUBLE) AS lon,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS time,
       greatest(0.0, sum(o_totalprice) / 100000.0 - 2.0) AS precip
FROM {orders} JOIN {customer} ON c_custkey = o_custkey
GROUP BY c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "exchange_rate": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
       avg(o_totalprice) / 5000 AS usd_etb
FROM {orders}
GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)
HAVING extract(month FROM CAST(date_trunc('month', o_orderdate) AS DATE)) <> 6""",
    "fao_index": """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
       avg(l_extendedprice) / 500 AS fao_index
FROM {lineitem}
GROUP BY CAST(date_trunc('month', l_shipdate) AS DATE)
HAVING extract(month FROM CAST(date_trunc('month', l_shipdate) AS DATE)) <> 9""",
    "regular_series": """
SELECT concat('m', CAST(l_suppkey AS VARCHAR(9))) AS series_id,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
       avg(l_extendedprice / l_quantity) AS price
FROM {lineitem}
GROUP BY l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE)
HAVING (l_suppkey + extract(month FROM CAST(date_trunc('month', l_shipdate) AS DATE))) % 5 <> 0""",
    # The same three without their gaps.
    "exchange_months": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice) / 5000 AS usd_etb
FROM {orders} GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "fao_months": """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, avg(l_extendedprice) / 500 AS fao_index
FROM {lineitem} GROUP BY CAST(date_trunc('month', l_shipdate) AS DATE)""",
    "series_months": """
SELECT concat('m', CAST(l_suppkey AS VARCHAR(9))) AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
       avg(l_extendedprice / l_quantity) AS price
FROM {lineitem} GROUP BY l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE)""",
    "predictions": """
SELECT CASE WHEN l_shipdate < TIMESTAMP '2000-01-01 00:00:00' THEN 'train' ELSE 'test' END AS split,
       CAST(l_shipdate AS DATE) AS date,
       l_extendedprice AS actual,
       l_quantity * p_retailprice * (1 - l_discount) AS predicted
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "shop_points": """
SELECT c_custkey AS point_id,
       CAST(-15 + (c_custkey * 37 % 740) * 0.05 + 0.013 AS DOUBLE) AS lat,
       CAST(25 + (c_custkey * 101 % 540) * 0.05 + 0.017 AS DOUBLE) AS lon
FROM {customer}""",
    "index_sheet": """
SELECT CAST(extract(year FROM d) * 12 + extract(month FROM d) AS INT) AS rn,
       concat(CAST(extract(year FROM d) AS VARCHAR(4)), 'M',
              CASE WHEN extract(month FROM d) < 10 THEN '0' ELSE '' END,
              CAST(extract(month FROM d) AS VARCHAR(2))) AS c0,
       CAST(CAST(energy AS BIGINT) AS VARCHAR(20)) AS c2,
       CASE WHEN extract(month FROM d) = 6 THEN '..' ELSE CAST(CAST(food AS BIGINT) AS VARCHAR(20)) END AS c6,
       CAST(CAST(fertilizer AS BIGINT) AS VARCHAR(20)) AS c12
FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS d,
             sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS energy,
             sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 END) AS food,
             sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 END) AS fertilizer
      FROM {orders} GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE)) m
UNION ALL SELECT 1, 'Monthly Indices', NULL, NULL, NULL
UNION ALL SELECT 2, NULL, 'Energy', 'Food', 'Fertilizers'""",
}

# Shapes of the areas of one country, in units of its block: level, order, name suffix and
# parts (each a list of rings, outer ring first). They hold every case the join must treat:
# neighbours with a shared edge, a triangle, a hole, two parts and overlapping areas.
_BOX = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
SHAPES = (
    (0, 0, "", [[_BOX(0.0, 0.0, 1.0, 1.0)]]),
    (1, 0, "-A0", [[_BOX(0.0, 0.0, 0.5, 0.75)]]),
    (1, 1, "-A1", [[[[0.5, 0.0], [1.0, 0.0], [0.5, 0.75], [0.5, 0.0]]]]),
    (2, 0, "-B0", [[_BOX(0.125, 0.125, 0.875, 0.875), _BOX(0.25, 0.25, 0.625, 0.5)]]),
    (3, 0, "-C0", [[_BOX(0.0, 0.0, 0.25, 0.25)], [_BOX(0.5, 0.5, 1.0, 0.75)]]),
    (3, 1, "-C1", [[_BOX(0.125, 0.125, 0.75, 0.75)]]),
)
_COLUMNS, _X0, _Y0, _W, _H = 5, 25.0, -15.0, 5.4, 7.4


class Inputs:
    """The tables of one folder and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in sql}
        return nan_to_null(self.spark.sql(sql, **used))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def collections(self, level: int) -> DataFrame:
        """GeoJSON text of each country's areas on one level."""
        k = F.col("n_nationkey")
        x = lambda u: F.lit(_X0) + (k % _COLUMNS) * F.lit(_W) + F.lit(u * _W)
        y = lambda v: F.lit(_Y0) + F.floor(k / _COLUMNS) * F.lit(_H) + F.lit(v * _H)
        ring = lambda pts: F.array(*[F.array(x(u), y(v)) for u, v in pts])

        def feature(suffix: str, parts: list):
            shape = F.array(*[F.array(*[ring(r) for r in part]) for part in parts])
            kind = "Polygon" if len(parts) == 1 else "MultiPolygon"
            where = F.to_json(shape[0] if len(parts) == 1 else shape)
            name = F.concat(F.col("n_name"), F.lit(suffix))
            # Every third country leaves its code to the reader.
            code = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(', "shapeGroup": "'), "n_name", F.lit('"')))
            return F.concat(
                F.lit('{"type": "Feature", "properties": {"shapeName": "'), name, F.lit('"'), code,
                F.lit('}, "geometry": {"type": "' + kind + '", "coordinates": '), where, F.lit("}}"))

        features = [feature(s, parts) for lv, _, s, parts in SHAPES if lv == level]
        text = F.concat(F.lit('{"type": "FeatureCollection", "features": ['),
                        F.concat_ws(", ", *features), F.lit("]}"))
        return self.nation.select("n_nationkey", "n_name", text.alias("value"))

    def layer(self, level: int) -> DataFrame:
        parsed = geojson.parse_collections(self.collections(level))
        rows = geojson.explode_features(parsed, level, F.col("n_name"), order=["n_nationkey"])
        return geojson.with_edges(rows)

    @cached_property
    def layers(self) -> DataFrame:
        out = self.layer(0)
        for level in (1, 2, 3):
            out = out.unionByName(self.layer(level))
        return out

    @cached_property
    def grid_layers(self) -> DataFrame:
        """Areas around the single cells of the rainfall grid: countries and second level."""
        k = F.col("n_nationkey")
        x, y = F.lit(25.0) + (k % 5) * F.lit(0.05), F.lit(-15.0) + F.floor(k / 5) * F.lit(0.05)
        h = F.lit(0.02)
        ring = F.array(*[F.array(x + a * h, y + b * h) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
        polys = F.array(F.array(ring))
        order = F.struct(k.alias("n_nationkey"), F.lit(0).alias("pos"))
        named = lambda level, name: self.nation.select(
            F.lit(level).alias("level"), order.alias("ord"), name.alias("name"), polys.alias("polys"))
        second = F.concat(F.col("n_name"), F.lit("-B"), (k % 5).cast("string"))
        return geojson.with_edges(named(0, F.col("n_name")).unionByName(named(2, second)))


def shapes_sql() -> str:
    """The segments of all areas for the check engine: one row per segment."""
    rows = []
    for level, order, suffix, parts in SHAPES:
        for part in parts:
            for ring in part:
                for (u1, v1), (u2, v2) in zip(ring, ring[1:]):
                    rows.append(f"({level}, {order}, '{suffix}', {u1 * _W!r}, {v1 * _H!r}, {u2 * _W!r}, {v2 * _H!r})")
    x = lambda c: f"CAST({_X0} AS DOUBLE) + (n_nationkey % {_COLUMNS}) * CAST({_W} AS DOUBLE) + {c}"
    y = lambda c: f"CAST({_Y0} AS DOUBLE) + floor(n_nationkey / {_COLUMNS}.0) * CAST({_H} AS DOUBLE) + {c}"
    return (f"SELECT level, n_nationkey, pos, concat(n_name, suffix) AS name, {x('u1')} AS x1, {y('v1')} AS y1, "
            f"{x('u2')} AS x2, {y('v2')} AS y2 FROM nation CROSS JOIN (SELECT level, pos, suffix, "
            "CAST(u1 AS DOUBLE) AS u1, CAST(v1 AS DOUBLE) AS v1, CAST(u2 AS DOUBLE) AS u2, CAST(v2 AS DOUBLE) AS v2 "
            "FROM (VALUES " + ",\n  ".join(rows) + ") s(level, pos, suffix, u1, v1, u2, v2)) t")
