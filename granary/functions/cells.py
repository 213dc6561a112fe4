"""Cell ids that bring scattered points and grid cells onto common keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SQRT3 = math.sqrt(3.0)


def grid_index(c: Column, origin: float, step: float) -> Column:
    """Integer position of a grid coordinate. Joins use it in place of raw doubles."""
    return F.round((c - F.lit(origin)) / F.lit(step)).cast("int")


def square_cell(lat: Column, lon: Column, size: float) -> Column:
    iy, ix = (F.floor(c / F.lit(size)).cast("string") for c in (lat, lon))
    return F.concat(F.lit("s"), iy, F.lit("_"), ix)


def hexagon_cell(lat: Column, lon: Column, size: float) -> Column:
    """Axial id of a pointy-top hexagon with the given edge length in degrees."""
    q = (lon * F.lit(_SQRT3 / 3.0) - lat * F.lit(1.0 / 3.0)) / F.lit(size)
    r = lat * F.lit(2.0 / 3.0) / F.lit(size)
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    hq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    hr = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return F.concat(
        F.lit("h"), hq.cast("long").cast("string"), F.lit("_"), hr.cast("long").cast("string")
    )


def assign_cell(lat: Column, lon: Column, size: float, kind: str = "square") -> Column:
    return {"square": square_cell, "hexagon": hexagon_cell}[kind](lat, lon, size)
