"""Regular grids, one row per cell and month. Cells are named by integer ``iy, ix``."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.functions.cells import grid_index

#: Default study box and years, inclusive on both ends.
DEFAULT_BOX = {"lon_min": 25.0, "lon_max": 52.0, "lat_min": -15.0, "lat_max": 22.0}
DEFAULT_YEARS = {"year_start": 2016, "year_end": 2024}


def clip_grid(df: DataFrame, lon_min: float = DEFAULT_BOX["lon_min"], lon_max: float = DEFAULT_BOX["lon_max"],
              lat_min: float = DEFAULT_BOX["lat_min"], lat_max: float = DEFAULT_BOX["lat_max"],
              year_start: int = DEFAULT_YEARS["year_start"], year_end: int = DEFAULT_YEARS["year_end"]) -> DataFrame:
    """Rows inside the box and the years. Plain comparisons, so they reach the file scan."""
    return df.filter(
        F.col("lat").between(lat_min, lat_max) & F.col("lon").between(lon_min, lon_max)
        & F.col("time").between(F.lit(f"{year_start}-01-01").cast("date"), F.lit(f"{year_end}-12-31").cast("date")))


def with_indices(df: DataFrame, lat0: float, lon0: float, step: float) -> DataFrame:
    return df.withColumns({"iy": grid_index(F.col("lat"), lat0, step), "ix": grid_index(F.col("lon"), lon0, step)})


def land_mask(df: DataFrame, mask: DataFrame, keys: Sequence[str] = ("iy", "ix")) -> DataFrame:
    """Rows whose cell is set in the mask grid."""
    return df.join(mask.select(*keys), list(keys), "left_semi")


def year_slice(df: DataFrame, year: int, time: str = "time") -> DataFrame:
    """Rows of one year, or of the last available year where that one has none."""
    y = F.year(time)
    chosen = df.agg(F.coalesce(F.max(F.when(y == year, y)), F.max(y))).scalar()
    return df.filter(y == chosen)


def complete_grid(df: DataFrame, value: str, time: str = "time") -> DataFrame:
    """Every month of every cell of the bounding index box; missing rows become NULL rows.

    The lattice is generated from the bounds, months first, then spread by month before
    the cells are written out, so no task holds more than some months of it.
    """
    bounds = df.agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.min("iy").alias("y0"),
                    F.max("iy").alias("y1"), F.min("ix").alias("x0"), F.max("ix").alias("x1"))
    months = bounds.filter("t0 IS NOT NULL").select(
        F.explode(F.sequence("t0", "t1", F.expr("interval 1 month"))).alias(time), "y0", "y1", "x0", "x1")
    lattice = months.repartition(F.col(time)).select(
        time, F.explode(F.sequence("y0", "y1")).alias("iy"), "x0", "x1",
    ).select(time, "iy", F.explode(F.sequence("x0", "x1")).alias("ix"))
    return lattice.join(df.select(time, "iy", "ix", value), [time, "iy", "ix"], "left")


def fill_nearest(df: DataFrame, value: str, time: str = "time", max_radius: float | None = None) -> DataFrame:
    """Missing cells take the value of the nearest cell of the same month, in index space.

    ``df`` holds every cell (see ``complete_grid``). Distance ties go to the smaller
    ``iy``, then the smaller ``ix``. Months without any value stay as they are.

    The search is split by axis. Along each grid line the nearest value to the left and to
    the right is found with running windows; a line is as long as the grid is wide. Then each
    column, as long as the grid is high, takes the lower envelope of its lines' distances in
    one pass up and one down (see :func:`nearest_rows`). No cell pairs are joined.
    """
    line = W.partitionBy(time, "iy")
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("ix").alias("sx"), F.col(value).alias("v")))
    left = F.last(here, True).over(line.orderBy("ix").rowsBetween(W.unboundedPreceding, 0))
    right = F.last(here, True).over(line.orderBy(F.col("ix").desc()).rowsBetween(W.unboundedPreceding, 0))
    sides = df.select(time, "iy", "ix", value, left.alias("l"), right.alias("r"))
    use_left = F.col("r").isNull() | (F.col("ix") - F.col("l.sx") <= F.col("r.sx") - F.col("ix"))
    nearest = sides.withColumn("near", F.when(use_left, F.col("l")).otherwise(F.col("r")))
    cell = F.struct(F.col("iy").cast("long").alias("iy"), F.col(value).alias("own"),
                    F.abs(F.col("ix") - F.col("near.sx")).cast("long").alias("dx"), F.col("near.v").alias("v"))
    columns = nearest.groupBy(time, "ix").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    limit = float("inf") if max_radius is None else float(max_radius) ** 2

    def search(batches):
        for batch in batches:
            cells = batch.column("cells")
            flat, ends = cells.flatten(), cells.offsets.to_numpy() - cells.offsets[0].as_py()
            rows, reach = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("iy", "dx"))
            source, squared = np.empty(len(flat), np.int64), np.empty(len(flat))
            for start, end in zip(ends[:-1], ends[1:]):
                place, d2 = nearest_rows(rows[start:end], reach[start:end])
                source[start:end], squared[start:end] = place + start, d2
            known = squared <= limit
            filled = flat.field("v").take(pa.array(np.where(known, source, 0), mask=~known))
            listed = lambda values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(time), batch.column("ix"), listed(flat.field("iy")), listed(flat.field("own")), listed(filled)],
                                             names=[time, "ix", "iy", "own", "fill"])

    kinds = {f.name: f.dataType.simpleString() for f in nearest.schema}
    schema = f"`{time}` {kinds[time]}, ix {kinds['ix']}, iy array<long>, own array<{kinds[value]}>, fill array<{kinds[value]}>"
    cells = columns.select(time, "ix", "cells").mapInArrow(search, schema).select(
        time, "ix", F.explode(F.arrays_zip("iy", "own", "fill")).alias("c"))
    own, fill = F.col("c.own"), F.col("c.fill")
    return cells.select(
        time, F.col("c.iy").cast(kinds["iy"]).alias("iy"), "ix", F.coalesce(own, fill).alias(value),
        (own.isNull() & fill.isNotNull()).alias("was_filled"))


def nearest_rows(rows: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a column the place of the row whose value is nearest, and the squared distance.

    ``rows`` ascend; ``reach`` is each row's distance to a value on its own line (NaN: the line
    has none). The squared distances from one line form a parabola along the column. Going up, a
    stack keeps the parabolas of the lower envelope, each with the first row where it is strictly
    less than the one before it, so ties stay with the smaller row; going down, the rows read
    the stack off. Both passes are linear, in integers. Without any value the distance is infinite.
    """
    n = len(rows)
    place, best = np.zeros(n, np.int64), np.full(n, np.inf)
    offered = np.flatnonzero(~np.isnan(reach))
    if not len(offered):
        return place, best
    at, height = rows.tolist(), (np.nan_to_num(reach).astype(np.int64) ** 2).tolist()
    stack, first = [], []
    for i in offered.tolist():
        start = at[0]
        while stack:
            k = stack[-1]
            start = 1 + (at[i] * at[i] - at[k] * at[k] + height[i] - height[k]) // (2 * (at[i] - at[k]))
            if start > first[-1]:
                break
            stack.pop()
            first.pop()
            start = at[0]
        stack.append(i)
        first.append(start)
    owner = np.array(stack)[np.searchsorted(np.array(first), rows, side="right") - 1]
    squares = np.array(height)
    return owner, ((rows - rows[owner]) ** 2 + squares[owner]).astype(float)


@dataclass(frozen=True)
class Lattice:
    """A regular grid: origin, step and size."""

    lat0: float
    lon0: float
    step: float
    n_lat: int
    n_lon: int


def regrid_bilinear(df: DataFrame, source: Lattice, target: Lattice, value: str, time: str = "time") -> DataFrame:
    """Bilinear values on the target grid; NULL where a corner that counts is missing.

    The corner table depends on the two grids only. It is joined on the integer cell, and
    the four products are summed per target cell and month with map-side combine.
    """
    spark = df.sparkSession
    lines = spark.range(target.n_lat).select(F.col("id").cast("int").alias("ty"))
    points = lines.select("ty", F.explode(F.sequence(F.lit(0), F.lit(target.n_lon - 1))).alias("tx"))
    fy = (F.lit(target.lat0) + F.col("ty") * F.lit(target.step) - F.lit(source.lat0)) / F.lit(source.step)
    fx = (F.lit(target.lon0) + F.col("tx") * F.lit(target.step) - F.lit(source.lon0)) / F.lit(source.step)
    # Positions within rounding noise of a grid line lie on it.
    snap = lambda c: F.round(c, 9)
    placed = points.withColumns({"fy": snap(fy), "fx": snap(fx)}).withColumns(
        {"y0": F.floor("fy").cast("int"), "x0": F.floor("fx").cast("int")}
    ).withColumns({"wy": F.col("fy") - F.col("y0"), "wx": F.col("fx") - F.col("x0")})
    corner = lambda dy, dx: F.struct(
        (F.col("y0") + dy).alias("iy"), (F.col("x0") + dx).alias("ix"),
        ((F.col("wy") if dy else 1 - F.col("wy")) * (F.col("wx") if dx else 1 - F.col("wx"))).alias("w"))
    corners = placed.select(
        "ty", "tx", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("c"),
    ).select("ty", "tx", "c.iy", "c.ix", "c.w").filter(F.col("w") > 0)
    needed = corners.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("ty", "tx")))
    joined = df.filter(F.col(value).isNotNull()).select(time, "iy", "ix", value).join(needed, ["iy", "ix"])
    out = joined.groupBy(time, "ty", "tx").agg(
        F.sum(F.col("w") * F.col(value)).alias("_s"), F.count(F.lit(1)).alias("_c"), F.max("n").alias("_n"))
    return out.select(
        time, "ty", "tx", (F.lit(target.lat0) + F.col("ty") * F.lit(target.step)).alias("lat"),
        (F.lit(target.lon0) + F.col("tx") * F.lit(target.step)).alias("lon"),
        F.when(F.col("_c") == F.col("_n"), F.col("_s")).alias(value))


def monthly_anomaly(df: DataFrame, value: str, keys: Sequence[str] = ("iy", "ix"), time: str = "time",
                    dry_below: float = -1.0) -> DataFrame:
    """Z-score within the cell and calendar month (sample deviation), and a drought flag.

    A group is one month of the year in one cell: as many rows as there are years.
    """
    w = W.partitionBy(*keys, F.month(time))
    z = F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))
    return df.withColumn("precip_anomaly", z).withColumn(
        "is_drought", F.when(F.col("precip_anomaly").isNotNull(), (F.col("precip_anomaly") < dry_below).cast("int")))


def grid_resolution(df: DataFrame, lat: str = "lat", lon: str = "lon", digits: int = 6) -> DataFrame:
    """Most frequent step between neighbouring distinct coordinates, per axis; ties to the
    smaller step. Only the distinct coordinates of an axis meet in one window."""
    both = df.unpivot([], [lat, lon], "axis", "at").filter(F.col("at").isNotNull()).distinct()
    step = F.round(F.col("at") - F.lag("at").over(W.partitionBy("axis").orderBy("at")), digits)
    counts = both.select("axis", step.alias("step")).filter("step IS NOT NULL").groupBy("axis", "step").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.groupBy("axis").agg(F.min_by("step", F.struct(-F.col("n"), "step")).alias("step"))
