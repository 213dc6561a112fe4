"""Golden rows and invariants of single operators on small hand-made tables."""

import datetime as dt
import json
import math
import time
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.functions import cells, dates, names, numeric, tails
from granary.functions.numeric import nan_to_null
from granary.operators import (
    clusters, correlation, forecast, grids, index, lookup, panel, quantiles, regression, series, spatial, stationarity, summary, trees,
)
from granary.operators.series import Series
from granary.session import shared_folder
from granary.sources import cubes, geojson, tables

S = Series(("k",))


def months(n, start="2000-01-01"):
    return [d.date() for d in pd.date_range(start, periods=n, freq="MS")]


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


# --- text, numbers, dates ---------------------------------------------------------------

UNITS = ["100 KG", "KG", "3.5 KG", "L", "500 ML", "LCU/3.5kg", "10 x 500 kg", "Head", None, "0 KG"]


@pytest.mark.parametrize("mode, want", [
    ("first_number", [100, 1, 3.5, 1, 500, 3.5, 10, 1, 1, 0]),
    ("kg_or_litre", [100, 1, 3.5, 1, 500, 3.5, 10500, None, None, 0]),
    ("first_digits", [100, 1, 3, 1, 500, 3, 10, 1, 1, 0]),
    ("sack", [100, 1, 1, 1, 1, 1, 1, 1, 1, 1]),
])
def test_unit_weights(spark, mode, want):
    df = spark.createDataFrame(list(enumerate(UNITS)), "i int, unit string")
    got = column(df.withColumn("w", names.unit_weight(F.col("unit"), mode).cast("double")), "w", "i")
    assert got == want


def test_zero_weight_gives_no_price(spark):
    df = spark.createDataFrame([("0 KG", 5.0), ("2 KG", 5.0)], "unit string, usdprice double")
    assert column(panel.price_per_kg(df), "price_per_kg", "unit") == [None, 2.5]


def test_first_target_in_list_order_wins(spark):
    df = spark.createDataFrame([("Rice and Maize",), ("maize",), ("Milk",)], "n string")
    got = df.select(names.commodity_group(F.col("n"), names.STAPLES).alias("a"),
                    names.commodity_group(F.col("n"), names.STAPLES, True).alias("b")).collect()
    assert [tuple(r) for r in got] == [("Maize", "Maize"), ("maize", "Maize"), ("Milk", "Milk")]


def test_date_forms(spark):
    df = spark.createDataFrame([("1960M01",), ("2001-05",), ("2001-05-17",), ("..",), (None,)], "t string")
    assert [r[0] for r in df.select(dates.parse_date(F.col("t"))).collect()] == [
        dt.date(1960, 1, 1), dt.date(2001, 5, 1), dt.date(2001, 5, 17), None, None]


def test_missing_counts_as_zero_in_the_split(spark):
    df = numeric.nan_to_null(spark.createDataFrame([(float("nan"),), (-1.0,), (0.7,)], "x double"))
    got = df.select(numeric.below(F.col("x"), -0.5), numeric.above(F.col("x"), 0.5)).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (-1.0, 0.0), (0.0, 0.7)]


def test_class_edges(spark):
    xs = [-2.0, -1.5, -1.0, 0.0, 1.0, 1.5, 2.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(numeric.index_class(F.col("x"))).collect()] == [
        "extreme drought", "severe drought", "moderate drought", "normal", "moderate wet", "severe wet", "extreme wet", None]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "x double, y double")
    assert df.agg(numeric.safe_corr(F.col("x"), F.col("y"))).first()[0] is None


def test_tails_against_integration():
    x = np.linspace(1e-9, 7.0, 400001)
    for a in (0.7, 2.5, 6.0):
        density = np.exp((a - 1) * np.log(x) - x - math.lgamma(a))
        if a > 1:
            assert abs(tails.gamma_cdf(np.array([a]), np.array([7.0]))[0] - np.trapezoid(density, x)) < 1e-7
    for a in (1e6, 1e8, 1e11):  # the expansion, against a normal law with the skewness of the gamma law
        for z in (-2.5, -0.3, 0.0, 0.7, 2.0):
            got = tails.gamma_cdf(np.array([a]), np.array([a + z * math.sqrt(a)]))[0]
            density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
            assert abs(got - (0.5 * math.erfc(-z / math.sqrt(2)) - density * (z * z - 1) / (3 * math.sqrt(a)))) < 3 / a
    edge = np.array([9999.999, 10000.001])  # both sides of the switch
    for x in (9800.0, 9999.5, 10250.0):
        low, high = tails.gamma_cdf(edge, np.array([x, x]))
        assert abs(low - high) < 1e-4
        assert abs(tails._gamma_cdf_large(edge[:1], np.array([x]))[0] - low) < 1e-8
    p = np.array([0.001, 0.2, 0.5, 0.9, 0.99999])
    z = tails.normal_quantile(p)
    assert np.allclose([0.5 * math.erfc(-v / math.sqrt(2)) for v in z], p, atol=1e-14)
    assert abs(tails.beta_cdf(np.array([0.3]), np.array([2.0]), np.array([3.0]))[0] - 0.3483) < 1e-4


# --- sources ----------------------------------------------------------------------------

def test_csv_round_trip_prunes_and_coerces(spark):
    rows = [("ETH", "a", "b", 1, "m", 1.5, float("nan"), dt.date(2020, 1, 15), "Maize", "KG", 2.0, "x")]
    df = spark.createDataFrame(rows, "iso string, admin1 string, admin2 string, market_id long, market string, latitude double, "
                                     "longitude double, date date, commodity string, unit string, usdprice double, extra string")
    path = tables.write_csv(df, shared_folder(spark) + ".csv")
    back = tables.read_prices(spark, path, {"iso": "countryiso3"})
    assert back.columns == tables.PRICE_SCHEMA.names
    row = back.first()
    assert row.longitude is None and row.date == dt.date(2020, 1, 15) and row.usdprice == 2.0


def test_missing_columns_and_files(spark):
    with pytest.raises(tables.MissingColumns):
        tables.conform(spark.range(1), tables.PRICE_SCHEMA)
    with pytest.raises(FileNotFoundError):
        tables.read_existing(spark, ["/tmp/no-such-table"])


def test_materialize_reuses(spark):
    path = shared_folder(spark)
    first = tables.materialize(spark.range(3), path)
    second = tables.materialize(spark.range(99), path)
    assert first.count() == second.count() == 3


def test_flatten_grid_order_and_nan(spark):
    df = spark.createDataFrame([(1, [10.0, 20.0], [1.0, 2.0, 3.0], [[1.0, 2.0, float("nan")], [4.0, 5.0, 6.0]])],
                               "t int, lat array<double>, lon array<double>, values array<array<double>>")
    got = {(r.lat, r.lon): r.value for r in cubes.flatten_grid(df).collect()}
    assert got[(10.0, 2.0)] == 2.0 and got[(20.0, 3.0)] == 6.0 and got[(10.0, 3.0)] is None and len(got) == 6


# --- areas ------------------------------------------------------------------------------

def square(x, y, d):
    return [[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]


@pytest.fixture(scope="module")
def layer(spark):
    feature = lambda name, kind, coords, code=True: {
        "type": "Feature", "properties": {"shapeName": name, **({"shapeGroup": name.upper()} if code else {})},
        "geometry": {"type": kind, "coordinates": coords}}
    doc = {"type": "FeatureCollection", "features": [
        feature("left", "Polygon", [square(0, 0, 2)]),
        feature("right", "Polygon", [square(2, 0, 2)]),
        feature("holed", "Polygon", [square(10, 0, 4), square(11, 1, 1)], code=False),
        feature("parts", "MultiPolygon", [[square(20, 0, 1)], [square(25, 3, 1)]]),
        feature("over", "Polygon", [square(1, 1, 2)]),
        feature("triangle", "Polygon", [[[30, 0], [34, 0], [30, 4], [30, 0]]])]}
    import os
    folder = shared_folder(spark)
    os.makedirs(folder)
    path = os.path.join(folder, "areas.geojson")
    with open(path, "w") as f:
        json.dump(doc, f, indent=1)
    return lambda level: geojson.read_boundaries(spark, {path: "XXX"}, level)


POINTS = [  # lon, lat, name
    (1.0, 0.5, "left"), (3.0, 0.5, "right"), (2.0, 0.5, None), (1.5, 1.5, "left"), (2.5, 2.5, "over"), (0.0, 0.0, None),
    (11.5, 1.5, None), (11.0, 1.5, None), (10.5, 0.5, "holed"), (13.5, 3.5, "holed"), (20.5, 0.5, "parts"), (25.5, 3.5, "parts"),
    (22.0, 2.0, None), (30.5, 0.5, "triangle"), (32.0, 2.0, None), (33.5, 1.5, None), (31.0, 2.0, "triangle"), (50.0, 50.0, None)]


@pytest.mark.parametrize("size", [1.0, 0.7, 5.0])
def test_points_in_areas(spark, layer, size):
    df = spark.createDataFrame([(i, y, x) for i, (x, y, _) in enumerate(POINTS)] + [(99, None, 1.0)], "i int, lat double, lon double")
    got = spatial.enrich_locations(df, layer(1), {1: "name"}, size=size)
    assert column(got, "name", "i") == [n for _, _, n in POINTS] + [None]


def test_country_code_falls_back(layer):
    assert [r.name for r in layer(0).orderBy("ord").collect()] == ["LEFT", "RIGHT", "XXX", "PARTS", "OVER", "TRIANGLE"]


@pytest.mark.parametrize("seed, radius", [(1, None), (2, None), (3, 2)])
def test_nearest_fill_against_brute_force(spark, seed, radius):
    rng = np.random.default_rng(seed)
    rows = []
    for t, share in ((0, 0.4), (1, 0.03), (2, 0.0)):
        for y in range(9):
            for x in range(13):
                rows.append((months(3)[t], y, x, float(rng.normal()) if rng.random() < share else None))
    df = spark.createDataFrame(rows, "time date, iy int, ix int, v double")
    got = {(r.time, r.iy, r.ix): r.v for r in grids.fill_nearest(df, "v", max_radius=radius).collect()}
    assert len(got) == len(rows)
    for t, y, x, v in rows:
        near = [((a - y) ** 2 + (b - x) ** 2, a, b, w) for s, a, b, w in rows if s == t and w is not None]
        near = [n for n in near if radius is None or n[0] <= radius ** 2]
        assert got[(t, y, x)] == (v if v is not None else min(near)[3] if near else None)


@pytest.mark.parametrize("seed", range(6))
def test_nearest_rows_keep_ties_with_the_smaller_row(seed):
    rng = np.random.default_rng(seed)
    rows = np.cumsum(rng.integers(1, 3, 40)) - 20
    reach = np.where(rng.random(40) < 0.7, rng.integers(0, 15, 40), np.nan)
    place, squared = grids.nearest_rows(rows, reach)
    for i, y in enumerate(rows):
        d2, row = min((int((y - a) ** 2 + r ** 2), a) for a, r in zip(rows, reach) if r == r)
        assert (squared[i], rows[place[i]]) == (d2, row)
    assert np.isinf(grids.nearest_rows(rows, np.full(40, np.nan))[1]).all()


def test_nearest_rows_take_time_in_proportion():
    def seconds(n):
        reach = np.random.default_rng(n).integers(0, n, n).astype(float)
        best = math.inf
        for _ in range(3):
            start = time.perf_counter()
            grids.nearest_rows(np.arange(n), reach)
            best = min(best, time.perf_counter() - start)
        return best
    assert seconds(64_000) < 16 * seconds(16_000)


def test_lagged_correlation_of_prepared_series(spark):
    rng = np.random.default_rng(3)
    y, x = np.exp(rng.normal(size=40)), rng.normal(size=40)
    rows = [("a", d, None if i in (0, 7, 8) else float(y[i]), None if i == 12 else float(x[i])) for i, d in enumerate(months(40)) if i != 20]
    rows += [("flat", d, 2.0, float(v)) for d, v in zip(months(5), x)]
    df = spark.createDataFrame(rows, "k string, month date, y double, x double")
    ready = correlation.lag_series(df, S, "y", "x")
    got = {(r.k, r.lag): r for r in correlation.lagged_correlation(ready, S, "y", "x", 6).collect()}
    price = pd.Series([np.nan if i in (0, 7, 8, 20) else y[i] for i in range(40)]).interpolate()
    target, feature = np.log(price + 1e-6)[1:], pd.Series([0.0 if i in (12, 20) else x[i] for i in range(40)])[1:]
    for k in range(7):
        assert got["a", k].n == 39 - k and got["a", k].corr == pytest.approx(target.corr(feature.shift(k)), abs=1e-12)
    assert {k: (got["flat", k].n, got["flat", k].corr) for k in range(5)} == {k: (5 - k, None) for k in range(5)}


def test_hexagon_is_the_nearest_centre(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-5, 5, (200, 2)))]
    df = spark.createDataFrame(pts, "i int, lat double, lon double").withColumn("c", cells.hexagon_cell(F.col("lat"), F.col("lon"), 0.8))
    centre = lambda q, r: (0.8 * math.sqrt(3) * (q + r / 2), 0.8 * 1.5 * r)
    for r in df.collect():
        q0, r0 = map(int, r.c[1:].split("_"))
        d = {(q, s): math.dist(centre(q, s), (r.lon, r.lat)) for q in range(q0 - 2, q0 + 3) for s in range(r0 - 2, r0 + 3)}
        assert min(d, key=d.get) == (q0, r0)


# --- series -----------------------------------------------------------------------------

def test_interpolation_equals_pandas(spark):
    m, v = months(8), [None, 1.0, None, None, 4.0, None, 10.0, None]
    df = spark.createDataFrame([("a", d, x) for d, x in zip(m, v)], "k string, month date, x double")
    assert column(series.interpolate(df, S, "x"), "x", "month") == [None, 1.0, 2.0, 3.0, 4.0, 7.0, 10.0, 10.0]


def test_dense_months_and_lags(spark):
    m = months(6)
    df = spark.createDataFrame([("a", m[0], 1.0), ("a", m[1], 2.0), ("a", m[4], 5.0), ("b", m[3], 9.0)], "k string, month date, x double")
    dense = series.as_monthly(df, S)
    assert [(r.k, r.month, r.x) for r in dense.orderBy("k", "month").collect()] == [
        ("a", m[0], 1.0), ("a", m[1], 2.0), ("a", m[2], None), ("a", m[3], None), ("a", m[4], 5.0), ("b", m[3], 9.0)]
    a = df.filter("k = 'a'")
    assert column(series.lag_rows(a, S, "x", [1]), "x_lag_1", "month") == [None, 1.0, 2.0]
    assert column(series.lag_months(a, S, "x", [1, 4]), "x_lag_1", "month") == [None, 1.0, None]
    assert column(series.lag_months(a, S, "x", [1, 4]), "x_lag_4", "month") == [None, None, 1.0]
    with pytest.raises(Exception, match="two rows"):
        series.as_monthly(df.union(df), S).collect()


def test_change_pads_forward_and_window_needs_all_rows(spark):
    m = months(5)
    df = spark.createDataFrame([("a", d, x) for d, x in zip(m, [2.0, None, 3.0, 0.0, 6.0])], "k string, month date, x double")
    assert column(series.percent_change(df, S, "x", "c"), "c", "month") == [None, 0.0, 0.5, -1.0, None]
    rolled = df.withColumn("r", series.rolling_past(S, "x", 2, "mean"))
    assert column(rolled, "r", "month") == [None, None, None, None, 1.5]
    acc = series.accumulate(df.filter("month <> '2000-02-01'"), S, "x", [2], "s")
    assert column(acc, "s_2", "month") == [None, None, 3.0, 6.0]


# --- lookups ----------------------------------------------------------------------------

@pytest.mark.parametrize("bound", [0, 100])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_is_the_same_join_on_either_way(spark, how, bound):
    rows = [("hot", i, None if i % 5 == 0 else i % 3) for i in range(4000)] + [(None, i, 1) for i in range(3000)] + [("rare", 1, 2), ("absent", 1, 1)] * 3
    df = spark.createDataFrame(rows, "k string, i int, j int").repartition(4)
    table = spark.createDataFrame([("hot", 1, "a"), ("hot", 2, "b"), ("rare", 2, "c"), (None, 1, "never"), ("hot", None, "never")], "k string, j int, name string")
    got = lookup.lookup(df, table, ["k", "j"], how, bound)
    assert got.columns == ["k", "i", "j", "name"]
    names = {("hot", 1): "a", ("hot", 2): "b", ("rare", 2): "c"}
    want = [(k, i, j, names.get((k, j))) for k, i, j in rows if how == "left" or (k, j) in names]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_large_lookup_spreads_a_hot_key(spark):
    df = spark.range(40_000).selectExpr("id", "CASE WHEN id % 5 < 2 THEN 0 ELSE id END AS k")
    out = lookup.lookup(df, spark.range(40_000).selectExpr("id AS k", "id AS v"), ["k"], bound=0)
    sizes = [r["count"] for r in out.repartition(8, "k").filter("k = 0").groupBy("v").count().collect()]
    text = out._jdf.queryExecution().executedPlan().toString()
    assert sizes == [16_000] and "_salt" in text


# --- quantiles --------------------------------------------------------------------------

@pytest.mark.parametrize("window_values", [0, 10, 10 ** 6])
def test_exact_quantiles_with_a_hot_group(spark, window_values):
    rng = np.random.default_rng(0)
    data = {"hot": rng.lognormal(size=20001), "ties": rng.integers(0, 3, 5000).astype(float), "two": np.array([1.0, 4.0]),
            "one": np.array([7.0]), "six": np.array([6.0, 1, 2, 4, 9, 3]), "same": np.full(9, 2.5),
            "wide": np.concatenate([[-1.7e308, 1.7e308], rng.normal(size=3001) * 1e-9]), None: np.array([5.0, 1.0, 2.0])}
    rows = [(k, float(x)) for k, xs in data.items() for x in xs] + [("void", None), ("two", None)]
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {r.k: r for r in quantiles.exact_quantiles(df, ["k"], "x", probs, window_values).collect()}
    assert set(got) == {*data, "void"} if window_values else set(got) - {"void"} == set(data)
    assert got["void"].c is None
    for k, xs in data.items():
        want = np.quantile(xs, list(probs.values())) if k != "wide" else np.sort(xs)[[0, 750, 1501, 2701, 3002]]
        assert np.allclose([got[k][n] for n in probs][:5 if k != "wide" else 3], want[:5 if k != "wide" else 3], rtol=1e-12)
    whole = quantiles.exact_quantiles(df.filter("k = 'hot'"), [], "x", {"m": 0.5}, window_values).first().m
    assert whole == np.median(data["hot"])


def test_quantiles_read_their_input_once(spark, tmp_path):
    spark.range(5000).selectExpr("id % 7 AS k", "rand(3) AS x").write.parquet(str(tmp_path / "t"))
    out = quantiles.exact_quantiles(spark.read.parquet(str(tmp_path / "t")), ["k"], "x", {"m": 0.5}, 100)
    out.collect()
    text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("FileScan parquet") == 1, text


def test_quantiles_of_a_computed_value_with_gaps_read_their_input_once(spark, tmp_path):
    # Group 0 has few values and is ranked, the others are selected in rounds.
    spark.range(5000).selectExpr("id % 7 AS k", "if(id % 5 = 0, NULL, if(id % 7 = 0, id % 9, id) / 3) AS x", "id % 4 AS d").write.parquet(str(tmp_path / "t"))
    rows = nan_to_null(spark.read.parquet(str(tmp_path / "t")).selectExpr("k", "CASE WHEN d = 3 THEN NULL ELSE x / 2 END AS x"))
    out = quantiles.exact_quantiles(panel.with_keys(rows, ["k"]), ["k"], "x", {"m": 0.5}, 100)
    assert column(out, "m", "k") == pytest.approx(column(rows.groupBy("k").agg(F.median("x").alias("m")), "m", "k"))
    out.collect()
    text = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("FileScan parquet") == 1, text


def test_a_key_of_families_tests_the_name_and_not_each_target(spark):
    df = spark.createDataFrame([("Rice and Maize", 1.0), ("maize", 2.0), (None, 3.0), ("Milk", None)], "commodity string, x double")
    df = df.withColumn("commodity", F.when(F.col("x") > 100, "much").otherwise(F.col("commodity")))
    rows = panel.with_keys(panel.only_groups(df, names.STAPLES, True), ["commodity_group"])
    assert sorted(r["commodity_group"] for r in rows.collect()) == ["Maize", "Maize", "Milk"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    tests = [line for line in plan.splitlines() if "Filter" in line]
    assert tests and not any("Contains" in line or "lower" in line for line in tests), plan
    assert "lambda" not in plan


# --- index ------------------------------------------------------------------------------

def rain(spark, n_years=40, n_cells=2, dry=0.0):
    rng = np.random.default_rng(3)
    rows = [(0, c, d, 0.0 if rng.random() < dry else float(rng.gamma(2.0, 30.0)))
            for c in range(n_cells) for d in months(12 * n_years)]
    return spark.createDataFrame(rows, "iy int, ix int, time date, precip double")


def test_index_is_standard_normal_per_calendar_month(spark):
    got = index.spi(rain(spark), scales=(1, 6)).groupBy("ix", "scale", F.month("time").alias("m")).agg(
        F.avg("spi").alias("m1"), F.stddev_pop("spi").alias("s1"), F.count_if(F.col("spi").isNull()).alias("gaps")).collect()
    assert all(abs(r.m1) < 0.06 and abs(r.s1 - 1) < 0.12 for r in got)
    assert sum(r.gaps for r in got if r.scale == 6) == 2 * 5 and sum(r.gaps for r in got if r.scale == 1) == 0


def test_dry_months_share_the_zero_mass_and_flat_months_are_null(spark):
    one = index.spi(rain(spark, n_cells=1, dry=0.3), scales=(1,))
    zero = rain(spark, n_cells=1, dry=0.3).join(one.select("time", "spi"), "time").filter("precip = 0").groupBy(
        F.month("time").alias("m")).agg(F.min("spi").alias("a"), F.max("spi").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    for r in zero:
        assert r.a == r.b and abs(r.a - tails.normal_quantile(np.array([r.n / 40]))[0]) < 1e-9
    flat = rain(spark, 6, 1).withColumn("precip", F.lit(5.0))
    assert index.spi(flat, scales=(1,)).filter("spi IS NOT NULL").count() == 0


def test_calibration_clamp():
    assert index.clamp_calibration((1991, 2020), (2016, 2024)) == (2016, 2020)
    assert index.clamp_calibration((2000, 2010), (1990, 2020)) == (2000, 2010)
    with pytest.raises(ValueError):
        index.clamp_calibration((1991, 2020), (2021, 2024))


# --- regressions ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(11)
    rows = []
    for g in "ab":
        for c in ("P", "Q", "R"):
            for i in range(60):
                x, z = float(rng.normal(50, 2)), float(rng.normal())
                rows.append((g, c, x, z, 2.0 + 0.3 * x - z + {"P": 0, "Q": 1, "R": -2}[c] + float(rng.normal())))
    return spark.createDataFrame(rows, "g string, c string, x double, z double, y double").persist()


def test_fit_agrees_with_mllib(sample):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    fit = {r.g: r for r in regression.grouped_ols(sample, ["g"], "y", ["x", "z"]).collect()}
    for g in "ab":
        rows = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(sample.filter(F.col("g") == g))
        ref = LinearRegression(solver="normal", labelCol="y").fit(rows)
        mine = fit[g]
        assert np.allclose([mine.coef_x, mine.coef_z, mine.intercept], [*ref.coefficients, ref.intercept], rtol=1e-8)
        assert np.allclose([mine.se_x, mine.se_z, mine.se_intercept], ref.summary.coefficientStandardErrors, rtol=1e-7)
        assert np.allclose([mine.p_x, mine.p_z, mine.p_intercept], ref.summary.pValues, atol=1e-9)
        assert abs(mine.r2 - ref.summary.r2) < 1e-10


def test_country_effects_equal_dummies(sample):
    dummies = sample.withColumns({"q": (F.col("c") == "Q").cast("double"), "r": (F.col("c") == "R").cast("double")})
    one = {r.g: r for r in regression.grouped_ols(dummies, ["g"], "y", ["x", "z", "q", "r"]).collect()}
    fit = regression.grouped_ols(sample, ["g"], "y", ["x", "z"], "c")
    levels = {(r.g, r.c): r for r in regression.effect_levels(sample, fit, ["g"], "y", ["x", "z"], "c").collect()}
    for r in fit.collect():
        ref = one[r.g]
        assert np.allclose([r.coef_x, r.se_x, r.p_z, r.r2, r.aic, r.f], [ref.coef_x, ref.se_x, ref.p_z, ref.r2, ref.aic, ref.f], rtol=1e-8)
        assert np.allclose([levels[r.g, "Q"].versus_base, levels[r.g, "R"].versus_base, levels[r.g, "P"].level],
                           [ref.coef_q, ref.coef_r, ref.intercept], rtol=1e-7)


def test_residuals_are_orthogonal_and_rank_loss_is_null(sample):
    fit = regression.grouped_ols(sample, ["g"], "y", ["x", "z"])
    res = regression.fitted_residuals(sample, fit, ["g"], "y", ["x", "z"])
    r = res.agg(F.sum("residual"), F.sum(F.col("residual") * F.col("x")), F.sum(F.col("residual") * F.col("z"))).first()
    assert max(abs(v) for v in r) < 1e-7
    twice = sample.withColumn("w", F.col("x") * 2)
    assert regression.grouped_ols(twice, ["g"], "y", ["x", "w"]).filter("coef_x IS NOT NULL").count() == 0


# --- time-series models -----------------------------------------------------------------

def test_stationarity_tells_a_walk_from_noise(spark):
    rng = np.random.default_rng(4)
    noise = rng.normal(size=200)
    rows = [("noise", d, float(x)) for d, x in zip(months(200), noise)]
    rows += [("walk", d, float(x)) for d, x in zip(months(200), np.cumsum(noise))]
    rows += [("flat", d, 1.0) for d in months(50)]
    got = {r.k: r for r in stationarity.stationarity(spark.createDataFrame(rows, "k string, month date, x double"), S, "x").collect()}
    assert got["noise"].p_value < 0.01 and got["noise"].stationary and got["walk"].p_value > 0.1 and not got["walk"].stationary
    assert got["flat"].statistic is None and got["flat"].p_value is None


def test_forecast_of_a_noiseless_autoregression(spark):
    y, x = [1.0, 0.5], [math.sin(i) for i in range(80)]
    for i in range(2, 80):
        y.append(0.2 + 0.6 * y[-1] + 0.5 * x[i])
    rows = [("a", d, v, u) for d, v, u in zip(months(80), y, x)] + [("short", d, 1.0, 1.0) for d in months(20)]
    df = spark.createDataFrame(rows, "k string, month date, y double, x double").filter("month > '2000-02-01'")
    out = forecast.forecast_arx(df, S, "y", ["x"], forecast.Order(1, 0, 0, 0, 0, 0)).collect()
    assert {r.k for r in out} == {"a"} and len(out) == 12
    assert all(abs(r.predicted - r.actual) < 1e-6 and r.lower <= r.actual * 1.000001 for r in out)
    walk = forecast.forecast_arx(df, S, "y", ["x"], forecast.Order(1, 1, 1, 1, 0, 0)).collect()
    assert all(r.lower < r.predicted < r.upper for r in walk)
    best = forecast.order_search(df, S, "y", ["x"]).collect()
    assert len(best) == 1 and best[0].model_order.startswith("(1,")
    subsets = forecast.feature_subsets(df.withColumn("z", F.rand(1)), S, "y", ["x", "z"]).collect()
    assert {r.features for r in subsets} == {"x", "z", "x, z"}
    assert max(subsets, key=lambda r: r.r2).features in ("x", "x, z")


# --- trees and clusters -----------------------------------------------------------------

def test_pooled_forest_beats_the_mean(spark, sample):
    rows = sample.withColumn("split", F.when(F.rand(1) < 0.8, "train").otherwise("test"))
    scored, _ = trees.fit_and_score(rows, trees.forest("y", numTrees=10, maxDepth=6), ["x", "z"], "y")
    assert {r.split: r.r2 for r in summary.fit_metrics(scored, ["split"]).collect()}["train"] > 0.5


def tree_by_hand(x, y, w, depth, penalty, least, at=None):
    """(value of each row's leaf, gain by feature) of one tree, every split tried one by one."""
    at = np.arange(len(y)) if at is None else at
    live = at[w[at] > 0]
    total, weight = (w * y)[live].sum(), w[live].sum()
    value, gains = np.zeros(len(y)), np.zeros(len(x))
    value[at] = total / (weight + penalty) if weight else 0.0
    best = (least, None)
    if depth and len(live):
        for f in range(len(x)):
            for low, high in zip(np.unique(x[f, live])[:-1], np.unique(x[f, live])[1:]):
                left = live[x[f, live] <= low]
                g, h = (w * y)[left].sum(), w[left].sum()
                gain = g ** 2 / (h + penalty) + (total - g) ** 2 / (weight - h + penalty) - total ** 2 / (weight + penalty)
                if gain > best[0] + 1e-10:
                    best = (gain, (f, (low + high) / 2))
    if best[1]:
        f, cut = best[1]
        gains[f] += best[0]
        for side in (at[x[f, at] < cut], at[x[f, at] >= cut]):
            v, g = tree_by_hand(x, y, w, depth - 1, penalty, least, side)
            value[side] = v[side]
            gains += g
    return value, gains


@pytest.mark.parametrize("penalty", [0.0, 1.0])
def test_trees_split_as_trying_every_cut_does(penalty):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 3, 40))
    x[:, 1] = np.round(x[:, 1])
    x[:, 2] = x[:, 2] > 0
    y, w = rng.normal(size=(5, 40)), rng.integers(0, 3, (5, 40)).astype(float)
    w[4] = 0
    w[4, :1] = 1
    for depth in (1, 3, 6):
        value, gains = trees.grown(x, trees.sorted_rows(x), w * y, w, depth, penalty, 1e-9)
        for i in range(5):
            v, g = tree_by_hand(x[i], y[i], w[i], depth, penalty, 1e-9)
            assert np.allclose(value[i], v) and np.allclose(gains[i], g)


def test_boosting_adds_up_shrunken_trees():
    rng = np.random.default_rng(6)
    x, y, w = rng.normal(size=(1, 2, 30)), rng.normal(size=(1, 30)), np.ones((1, 30))
    w[0, 20:] = 0
    predicted, _ = trees.boosted(x, y, w, 3, 0.5, 2)
    want = np.full(30, y[0, :20].mean())
    for _ in range(3):
        want += 0.5 * tree_by_hand(x[0], y[0] - want, w[0], 2, trees.PENALTY, trees.LEAST_GAIN)[0]
    assert np.allclose(predicted[0], want)


def test_series_models_follow_their_series(spark):
    rng = np.random.default_rng(9)
    rows = [(k, d, float(sign * v + 0.01 * rng.normal()), float(v), float(rng.normal())) for k, sign in (("a", 1), ("b", -1))
            for d, v in zip(months(90), rng.normal(size=90))]
    rows += [("short", d, 1.0, 1.0, 1.0) for d in months(12)] + [("a", months(200)[-1], None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, month date, y double, x double, z double")
    for model in (trees.forest_model(30, 6), trees.boosting_model(60, 0.2, 3)):
        fits = trees.series_fits(df, S, "y", ["x", "z"], model, 12)
        got = fits.collect()
        assert sorted(r.k for r in got) == ["a", "b"] and all(r.weights[0] > 0.9 and abs(sum(r.weights) - 1) < 1e-9 for r in got)
        assert all([m.split for m in r.months].count("test") == 12 and len(r.months) == 90 for r in got)
        errors = summary.fit_metrics(trees.fitted_months(fits, ["k"]), ["k", "split"]).collect()
        assert all(r.r2 > 0.7 for r in errors) and len(errors) == 4
        assert trees.series_fits(df, S, "y", ["x", "z"], model, 12).collect() == got
    assert [r.feature for r in trees.feature_weights(fits, ["k"], ["x", "z"], 1).collect()] == ["x", "x"]


def test_lag_scan_finds_the_lag_of_each_series(spark):
    rng = np.random.default_rng(8)
    rows = []
    for name, lag in (("a", 2), ("b", 5)):
        spi = rng.normal(size=160)
        rows += [(name, d, float(spi[i - lag] + 0.05 * rng.normal()) if i >= lag else 0.0, float(spi[i]), int(spi[i] < 0), 1.0)
                 for i, d in enumerate(months(160))]
    rows += [("few", d, 1.0, 1.0, 0, 1.0) for d in months(35)]
    df = spark.createDataFrame(rows, "k string, month date, y double, spi double, dry int, base double")
    scan = trees.drought_lag_scan(df, S, "y", "spi", "dry", ["base"], lags=(0, 2, 5), rounds=30, rate=0.3).collect()
    assert {(r.k, r.lag) for r in scan if r.best} == {("a", 2), ("b", 5)}
    assert {(r.k, r.lag, r.n, r.n_train) for r in scan} == {(k, lag, 160 - lag, 148 - lag) for k in "ab" for lag in (0, 2, 5)}
    assert all(r.sse_train < r.sst_train for r in scan)


def test_swept_fits_equal_their_own_least_squares():
    rng = np.random.default_rng(0)
    for constant in (True, False):
        x = rng.normal(size=(60, 6)) * [1, 100, 1e-3, 1, 1, 1] + [5, 0, 0, 0, 3, 0]
        x[:, 3], x[:, 4], x[:, 5] = x[:, 3] > 0, 2 * x[:, 0] - 1 * constant, 7.0
        y = x[:, 0] + rng.normal(size=60)
        sweep = forecast.Sweep(x, y, constant)
        subsets = [c for k in range(7) for c in combinations(range(6), k)]
        for wanted in sorted(subsets, key=forecast.gray_rank) + subsets:
            design = np.hstack([np.ones((60, 1 * constant)), x[:, wanted]])
            coef, err = sweep.fit(wanted)
            want = np.linalg.lstsq(design, y, rcond=None)[0]
            assert np.allclose(coef, want, rtol=1e-8, atol=1e-8) and np.allclose(err, y - design @ want, atol=1e-8)


def test_gray_neighbours_differ_in_one_member():
    subsets = sorted([set(c) for k in range(6) for c in combinations(range(5), k)], key=forecast.gray_rank)
    assert len(subsets) == 32 and all(len(a ^ b) == 1 for a, b in zip(subsets, subsets[1:]))


def test_centres_on_a_line(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.1, 200) for c in (0, 5, 9)] + [[4.0] * 50])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    for parts in (1, 5):
        centres = clusters.line_centres(df.repartition(parts), "x", 4)
        nearest = np.abs(x[:, None] - np.array(centres)).argmin(axis=1)
        assert len(centres) == 4 and np.allclose(centres, [x[nearest == i].mean() for i in range(4)])
        got = clusters.rate_clusters(df, "x", 4).collect()
        assert sorted((r.x, r.cluster) for r in got) == sorted(zip(x.tolist(), nearest.tolist()))
    assert clusters.line_centres(df.filter("x > 100"), "x", 4) == []
    assert clusters.line_centres(spark.createDataFrame([(1.0,)] * 9, "x double"), "x", 4) == [1.0]


def test_sweep_inertia_falls(spark):
    rng = np.random.default_rng(2)
    rows = [(i, d, float(rng.normal() + 10 * (i % 3))) for i in range(30) for d in months(6)]
    df = spark.createDataFrame(rows, "market_id int, month date, r double")
    dense = clusters.dense_series(df, "market_id", "month", "r", min_n=3)
    z = clusters.standardise_by_date(dense, "month", "r")
    got = clusters.sweep(clusters.market_vectors(z, "market_id", "month"), (2, 3, 4)).orderBy("k").collect()
    assert got[0].inertia > got[1].inertia >= got[2].inertia * 0.99
    assert max(got, key=lambda r: r.silhouette).k == 3


def test_codes_are_alphabetical_and_missing_is_minus_one(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    coded, mapping = summary.encode(df, ["c"])
    assert {(r.c, r.c_code) for r in coded.collect()} == {("a", 0), ("b", 1), (None, -1)}
    assert mapping.count() == 2


def test_pooled_forest_grows_alike_over_tasks_and_in_one(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 5, 400), rng.normal(size=400).round(1)])
    y = x[:, 0] + x[:, 1] ** 2 + rng.normal(size=400)
    rows = [(i, *map(float, v), float(t), "train" if i % 4 else "test") for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, y double, split string")

    def predicted(part, **params):
        scored, tops = trees.fit_and_score(part, trees.forest("y", numTrees=3, **params), ["a", "b", "c"], "y", ["i"])
        return {r.i: r.predicted for r in scored.collect()}, tops

    whole, _ = predicted(df, maxDepth=4)
    # The same trees from rounds over all tasks, and from rows in another order and other partitions.
    parts, tops = predicted(df, maxDepth=4, together=20)
    assert all(len(left) > 5 for left in tops.left)
    moved, _ = predicted(df.repartition(7), maxDepth=4)
    assert len(whole) == 400 and all(abs(parts[i] - p) < 1e-9 and abs(moved[i] - p) < 1e-9 for i, p in whole.items())


def test_tree_below_a_node_is_the_tree_by_hand():
    rng = np.random.default_rng(5)
    codes, y = rng.integers(0, 9, (3, 60)), rng.normal(size=60)
    w = trees.times_drawn(np.arange(60), 0, 1).astype(float)
    drawn = w > 0
    feature, cut, left, value = trees.grown_below(codes[:, drawn], y[drawn], w[drawn], 30, 1e-12)
    assert 0.8 < trees.times_drawn(np.arange(100_000), 3, 42).mean() / 1.0 < 1.2
    for depth in (1, 3):
        short = trees.grown_below(codes[:, drawn], y[drawn], w[drawn], depth, 1e-12)
        by_hand, _ = tree_by_hand(codes.astype(float), y, w, depth, 0.0, 1e-12)
        assert np.allclose(short[3][trees.walked(codes, *short[:3])][drawn], by_hand[drawn])
    # Rows of the same codes share a leaf, all others are told apart.
    ends = trees.walked(codes[:, drawn], feature, cut, left)
    assert len(set(ends.tolist())) == len({tuple(c) for c in codes[:, drawn].T})


def test_market_vectors_lie_in_few_tasks(spark):
    rows = [(m, d, float(m)) for m in range(40) for d in months(3)]
    vectors = clusters.market_vectors(spark.createDataFrame(rows, "m long, month date, z double").repartition(8), "m", "month")
    assert vectors.rdd.getNumPartitions() == 1
    assert [r.m for r in vectors.collect()] == list(range(40))


def test_admin2_panel_is_written_once(spark):
    from granary.plans import model_queries
    from granary.plans.inputs import Inputs
    rows, chosen = model_queries._densest(Inputs(spark, "/root/testdata/sf0.001"))
    for df in (rows, chosen):
        assert "lineitem" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_national_rows_and_panels_are_written_once(spark):
    from granary.plans import flows, model_queries
    from granary.plans.inputs import Inputs
    t = Inputs(spark, "/root/testdata/sf0.001")
    rows = model_queries._diagnosed(t)[0]
    wide = flows.with_best_scale(model_queries._forecast_panel(t), model_queries._NS)
    for df in (rows, wide):
        assert "lineitem" not in df._jdf.queryExecution().optimizedPlan().toString()
