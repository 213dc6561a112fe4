"""Point-in-polygon assignment without a spatial index.

Points and polygons meet on square buckets, so the join is an equi-join at any size. A
polygon is cut per bucket: only the segments a rightward ray from inside that bucket can
cross travel with it, so a country outline of a million points is spread over many small
rows instead of being copied whole into every bucket.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.lookup import lookup

BUCKET_DEGREES = 1.0


def bucket_layer(layer: DataFrame, size: float = BUCKET_DEGREES) -> DataFrame:
    """One row per polygon and bucket of its bounding box, with the segments that matter."""
    side = lambda c: F.floor(F.col(c) / F.lit(size))
    spread = layer.withColumn("by", F.explode(F.sequence(side("min_y"), side("max_y"))))
    # First by latitude band, so the second explode copies only that band's segments.
    band = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) >= F.col("by") * F.lit(size))
                    & (F.least(e["y1"], e["y2"]) <= (F.col("by") + 1) * F.lit(size)))
    spread = spread.withColumn("edges", band).withColumn(
        "bx", F.explode(F.sequence(side("min_x"), side("max_x"))))
    right = F.filter("edges", lambda e: F.greatest(e["x1"], e["x2"]) >= F.col("bx") * F.lit(size))
    return spread.withColumn("edges", right).filter(F.size("edges") > 0).select(
        "level", "ord", "name", "bx", "by", "edges", "min_x", "max_x", "min_y", "max_y")


def strictly_within(lon: Column, lat: Column, edges: Column) -> Column:
    """Even-odd rule in products, so level segments need no division; the outline itself,
    inner rings included, is outside."""
    turn = lambda e: (lon - e["x1"]) * (e["y2"] - e["y1"]) - (e["x2"] - e["x1"]) * (lat - e["y1"])
    crossed = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (
        F.when(e["y2"] > e["y1"], turn(e) < 0).otherwise(turn(e) > 0))
    touched = lambda e: (turn(e) == 0) & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) \
        & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    odd = F.size(F.filter(edges, crossed)) % 2 == 1
    return odd & ~F.exists(edges, touched)


def locate(points: DataFrame, layers: DataFrame, out: Mapping[int, str], lat: str = "lat", lon: str = "lon",
           size: float = BUCKET_DEGREES) -> DataFrame:
    """Distinct locations with the first matching polygon (by ``ord``) of every level.

    All levels are matched in one bucket join.
    """
    spots = points.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).dropna().distinct()
    spots = spots.withColumns({"bx": F.floor(F.col("_lon") / F.lit(size)), "by": F.floor(F.col("_lat") / F.lit(size))})
    boxed = (F.col("_lon") > F.col("min_x")) & (F.col("_lon") < F.col("max_x")) \
        & (F.col("_lat") > F.col("min_y")) & (F.col("_lat") < F.col("max_y"))
    hits = spots.join(bucket_layer(layers, size), ["bx", "by"]).filter(boxed).filter(
        strictly_within(F.col("_lon"), F.col("_lat"), F.col("edges")))
    first = lambda level: F.min_by("name", F.when(F.col("level") == level, F.col("ord")))
    return hits.groupBy("_lat", "_lon").agg(*[first(k).alias(v) for k, v in out.items()]).select(
        F.col("_lat").alias(lat), F.col("_lon").alias(lon), *out.values())


def enrich_locations(df: DataFrame, layers: DataFrame, out: Mapping[int, str], lat: str = "lat",
                     lon: str = "lon", size: float = BUCKET_DEGREES) -> DataFrame:
    """Adds the area names to every row, keeping rows outside all areas.

    Each distinct location is tested once and the result is looked up; rows without a location have no areas.
    """
    return lookup(df, locate(df, layers, out, lat, lon, size), [lat, lon])


ADMIN_COLUMNS = {0: "country_iso", 1: "admin1", 2: "admin2", 3: "admin3"}


def spatial_join(points: DataFrame, layer: DataFrame, level: int, col: str, lat: str = "lat",
                 lon: str = "lon") -> DataFrame:
    """Left-preserving join of points with one layer."""
    return enrich_locations(points, layer.filter(F.col("level") == level), {level: col}, lat, lon)
