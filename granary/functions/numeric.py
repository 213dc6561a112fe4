"""Numbers: missing values, logs, splits, correlation."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Class bounds of the standardised index, dry side inclusive.
EXTREME, SEVERE, MODERATE = 2.0, 1.5, 1.0

#: Fixed value: added to prices and indices before the log in the regressions.
LOG_EPSILON = 1e-6


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks a missing value in the sources; inside the engine it is always NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({n: null_if_nan(F.col(n)) for n in floats}) if floats else df


def to_number(c: Column) -> Column:
    """Text to double; cells that are no number become NULL."""
    return c.try_cast("double")


def log_of(c: Column, eps: float = LOG_EPSILON) -> Column:
    """``ln(c + eps)``; NULL where the argument is not positive."""
    return F.ln(c + F.lit(eps)) if eps else F.ln(c)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def below(c: Column, bound: float) -> Column:
    """The value where it lies under ``bound``, else 0 (also for NULL)."""
    return F.when(c < bound, c).otherwise(F.lit(0.0))


def above(c: Column, bound: float) -> Column:
    return F.when(c > bound, c).otherwise(F.lit(0.0))


def flag_below(c: Column, bound: float) -> Column:
    return F.when(c < bound, 1).otherwise(0)


def flag_above(c: Column, bound: float) -> Column:
    return F.when(c > bound, 1).otherwise(0)


def index_class(c: Column) -> Column:
    """Seven drought / wetness classes of a standardised index."""
    return (
        F.when(c <= -EXTREME, "extreme drought")
        .when(c <= -SEVERE, "severe drought")
        .when(c <= -MODERATE, "moderate drought")
        .when(c < MODERATE, "normal")
        .when(c < SEVERE, "moderate wet")
        .when(c < EXTREME, "severe wet")
        .when(c.isNotNull(), "extreme wet")
    )


def _where_complete(cols: list[Column], where: Column | None) -> list[Column]:
    keep = reduce(and_, (c.isNotNull() for c in cols))
    if where is not None:
        keep = keep & where
    return [F.when(keep, c) for c in cols]


def pair_count(x: Column, y: Column, where: Column | None = None) -> Column:
    return F.count(_where_complete([x, y], where)[0])


def safe_corr(x: Column, y: Column, where: Column | None = None, min_n: int = 2) -> Column:
    """Pearson correlation over complete pairs as one aggregate.

    NULL, not an error, for constant columns and for fewer than ``min_n`` pairs. The
    moments merge, so a hot group is combined on the map side.
    """
    a, b = _where_complete([x, y], where)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies & (F.count(a) >= min_n), r)
