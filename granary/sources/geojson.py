"""Boundary layers from GeoJSON feature collections."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POLYGON = "array<array<array<double>>>"
MULTI_POLYGON = f"array<{POLYGON}>"

# Coordinates stay text until the geometry type is known: the two types nest differently.
FEATURE_COLLECTION = (
    "features array<struct<"
    "properties: struct<shapeName: string, shapeGroup: string>,"
    "geometry: struct<type: string, coordinates: string>>>"
)


def polygons_of(kind: Column, coordinates: Column) -> Column:
    """Polygon and MultiPolygon coordinates in the nesting of the latter."""
    return F.when(kind == "Polygon", F.array(F.from_json(coordinates, POLYGON))).when(
        kind == "MultiPolygon", F.from_json(coordinates, MULTI_POLYGON)
    )


def ring_edges(polygons: Column) -> Column:
    """All ring segments of all parts, holes included, as ``(x1, y1, x2, y2)``."""
    rings = F.flatten(polygons)

    def segments(ring: Column) -> Column:
        ends = F.slice(ring, 2, F.size(ring) - 1)
        return F.zip_with(
            F.slice(ring, 1, F.size(ring) - 1), ends,
            lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")),
        )

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 1), segments))


def with_edges(layers: DataFrame) -> DataFrame:
    """Adds ``edges`` and the bounding box to a table with a ``polys`` column."""
    e = layers.withColumn("edges", ring_edges(F.col("polys")))
    both = lambda a, b: F.concat(F.transform("edges", lambda s: s[a]), F.transform("edges", lambda s: s[b]))
    return e.select(
        "*",
        F.array_min(both("x1", "x2")).alias("min_x"), F.array_max(both("x1", "x2")).alias("max_x"),
        F.array_min(both("y1", "y2")).alias("min_y"), F.array_max(both("y1", "y2")).alias("max_y"),
    )


def explode_features(collections: DataFrame, level: int, fallback: str | Column,
                     order: Sequence[str] = ()) -> DataFrame:
    """Rows with a ``features`` array to one row per feature: ``level, ord, name, polys``.

    Level 0 is named by the country code, ``fallback`` standing in where it is absent; the
    other levels by the shape name. ``ord`` follows ``order`` (columns of the collection,
    e.g. the file) and then the position in the collection: the first match wins by it.
    """
    code = fallback if isinstance(fallback, Column) else F.lit(fallback)
    rows = collections.select(
        *[F.col(c) for c in order], code.alias("_code"), F.posexplode("features").alias("_pos", "f")
    )
    name = F.coalesce(F.col("f.properties.shapeGroup"), F.col("_code")) if level == 0 else F.col(
        "f.properties.shapeName")
    return rows.select(
        F.lit(level).alias("level"),
        F.struct(*[F.col(c) for c in order], F.col("_pos").alias("pos")).alias("ord"),
        name.alias("name"),
        polygons_of(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("polys"),
    )


def parse_collections(texts: DataFrame, column: str = "value") -> DataFrame:
    """One JSON text per row to a ``features`` column."""
    others = [c for c in texts.columns if c != column]
    return texts.select(*others, F.from_json(column, FEATURE_COLLECTION).alias("_c")).select(
        *others, "_c.features")


def read_boundaries(spark: SparkSession, files: dict[str, str], level: int) -> DataFrame:
    """One layer from several files: path -> country code used where a feature has none."""
    layer = None
    for position, (path, code) in enumerate(files.items()):
        collection = spark.read.schema(FEATURE_COLLECTION).option("multiLine", True).json(path)
        rows = explode_features(
            collection.withColumn("file", F.lit(position)), level, code, order=["file"])
        layer = rows if layer is None else layer.unionByName(rows)
    return with_edges(layer)
