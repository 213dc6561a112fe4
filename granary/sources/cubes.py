"""Gridded input: array rows flattened to one row per cell and month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.numeric import null_if_nan


def flatten_grid(df: DataFrame, lat: str = "lat", lon: str = "lon",
                 values: str = "values", out: str = "value") -> DataFrame:
    """Rows of ``lat[]``, ``lon[]``, ``values[lat][lon]`` become ``(lat, lon, value)`` rows."""
    others = [F.col(c) for c in df.columns if c not in (lat, lon, values)]
    lines = df.select(
        *others, F.col(lon).alias("_lons"),
        F.posexplode(F.arrays_zip(F.col(lat).alias("lat"), F.col(values).alias("line"))).alias("iy", "_cell"),
    )
    cells = lines.select(
        *others, "iy", F.col("_cell.lat").alias("lat"),
        F.posexplode(F.arrays_zip(F.col("_lons").alias("lon"), F.col("_cell.line").alias("v"))).alias("ix", "_cell"),
    )
    return cells.select(*others, "iy", "ix", "lat", F.col("_cell.lon").alias("lon"),
                        null_if_nan(F.col("_cell.v")).alias(out))


def stack_scales(tables: dict[int, DataFrame], value: str = "value") -> DataFrame:
    """One table per accumulation scale, tagged with the scale and stacked.

    Each table carries its value in a column of its own or common name; it comes out as
    ``value``.
    """
    tagged = [
        df.withColumnRenamed(f"{value}_{k}", value).withColumn("scale", F.lit(k))
        for k, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), tagged)
