"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions.dates import parse_date
from granary.functions.numeric import to_number
from granary.operators import index, panel
from granary.plans.check_sql import accumulated
from granary.plans.registry import CTES, cte, query
from granary.session import shared_folder
from granary.sources import cubes, geojson, tables

PRICE_COLUMNS = "countryiso3 admin1 admin2 market_id market latitude:6 longitude:6 date:d commodity unit usdprice:6"


@query("a1_price_scan", PRICE_COLUMNS, "SELECT * FROM price_obs")
def price_scan(t):
    theirs = t.price_obs.withColumnsRenamed({"usdprice": "price_usd", "countryiso3": "iso3"})
    return tables.conform(theirs, tables.PRICE_SCHEMA, {"price_usd": "usdprice", "iso3": "countryiso3"})


@query("a2_index_scan", "lat:6 lon:6 time:d precip:4", "SELECT lat, lon, time, precip FROM grid_precip")
def index_scan(t):
    return tables.conform(t.grid_precip, tables.GRID_SCHEMA)


@query("a3_existing_inputs", "o_orderstatus n total:2",
       "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_orderstatus")
def existing_inputs(t):
    paths = [f"{t.folder}/orders.parquet", f"{t.folder}/orders_of_last_year.parquet"]
    found = tables.read_existing(t.spark, paths, ["o_orderstatus", "o_totalprice"])
    return found.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


cte("rain_sums_made", accumulated(index.GENERATED_SCALES))


@query("a4_stack_scales", "iy ix time:d scale value:4",
       "SELECT iy, ix, time, scale, total AS value FROM rain_sums_made")
def stack_scales(t):
    from granary.operators.series import Series, accumulate
    wide = accumulate(t.grid_precip, Series(("iy", "ix"), "time"), "precip", index.GENERATED_SCALES, "value")
    each = {k: wide.select("iy", "ix", "time", f"value_{k}") for k in index.GENERATED_SCALES}
    return cubes.stack_scales(each)


@query("a5_boundaries", "level n_nationkey pos name n_edges min_x:6 max_x:6 min_y:6 max_y:6", """
SELECT level, n_nationkey, pos, name, count(*) AS n_edges, min(least(x1, x2)) AS min_x, max(greatest(x1, x2)) AS max_x,
       min(least(y1, y2)) AS min_y, max(greatest(y1, y2)) AS max_y
FROM area_segments GROUP BY level, n_nationkey, pos, name""")
def boundaries(t):
    return t.layers.select("level", "ord.n_nationkey", "ord.pos", "name", F.size("edges").alias("n_edges"),
                           "min_x", "max_x", "min_y", "max_y")


@query("a6_flatten_grid", "o_orderkey time:d iy ix lat:6 lon:6 value:4", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS time, iy, ix, 10.0 + iy * 0.5 AS lat, 30.0 + ix * 0.5 AS lon,
       CASE WHEN iy = 0 AND ix = 0 THEN o_totalprice WHEN iy = 0 THEN CAST(o_custkey AS DOUBLE)
            WHEN ix = 0 THEN CAST(o_orderkey AS DOUBLE) END AS value
FROM orders CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(iy, ix)""")
def flatten_grid(t):
    number = lambda c: F.col(c).cast("double")
    cube = t.orders.select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("time"),
        F.array(F.lit(10.0), F.lit(10.5)).alias("lat"), F.array(F.lit(30.0), F.lit(30.5)).alias("lon"),
        F.array(F.array(number("o_totalprice"), number("o_custkey")),
                F.array(number("o_orderkey"), F.lit(float("nan")))).alias("values"))
    return cubes.flatten_grid(cube)


@query("a7_positional_sheet", "date:d energy_index:6 food_index:6 fertilizer_index:6", """
SELECT CAST(concat(substr(c0, 1, 4), '-', substr(c0, 6, 2), '-01') AS DATE) AS date, TRY_CAST(c2 AS DOUBLE) AS energy_index,
       TRY_CAST(c6 AS DOUBLE) AS food_index, TRY_CAST(c12 AS DOUBLE) AS fertilizer_index
FROM index_sheet WHERE rn >= (SELECT min(rn) FROM index_sheet WHERE c0 = '1996M01')
  AND (c2 IS NOT NULL OR c6 IS NOT NULL OR c12 IS NOT NULL)""")
def positional_sheet(t):
    rows = tables.read_sheet(t.index_sheet, start="1996M01")
    rows = rows.dropna("all", subset=["energy_index", "food_index", "fertilizer_index"])
    names = ["energy_index", "food_index", "fertilizer_index"]
    return rows.select(parse_date(F.col("date")).alias("date"), *[to_number(F.col(c)).alias(c) for c in names]).dropna(
        subset=["date"])


@query("a8_csv_sink", "month:d energy_index:6 food_index:6 fertilizer_index:6", "SELECT * FROM macro_month")
def csv_sink(t):
    from pyspark.sql.types import DateType, DoubleType, StructField, StructType
    schema = StructType([StructField("date", DateType())] + [
        StructField(c, DoubleType()) for c in ("energy_index", "food_index", "fertilizer_index")])
    path = tables.write_csv(t.macro_index, shared_folder(t.spark))
    return tables.read_csv(t.spark, path, schema).withColumnRenamed("date", "month")


@query("a9_parquet_sink", "country_iso day:d n mean_price:4", """
SELECT countryiso3 AS country_iso, CAST(date AS DATE) AS day, count(*) AS n, avg(usdprice) AS mean_price
FROM price_obs GROUP BY ALL""")
def parquet_sink(t):
    path = tables.write_parquet(t.price_obs, shared_folder(t.spark), ["countryiso3"])
    back = tables.read_prices(t.spark, path)
    return back.groupBy(F.col("countryiso3").alias("country_iso"), F.col("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("usdprice").alias("mean_price"))


@query("a10_materialize", "countryiso3 month:d commodity_group price_per_kg:5", "SELECT * FROM monthly_price")
def materialize(t):
    from granary.plans.flows import monthly_prices
    path = shared_folder(t.spark)
    tables.materialize(monthly_prices(t.price_obs), path)
    return tables.materialize(monthly_prices(t.price_obs), path)
