"""Time-series operators.

A series is named by its key columns and holds at most one row per date: raw observations
are averaged first (``panel.mean_by``). That bounds every window here by the calendar, a
few hundred months per series, however many raw rows one market has.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.functions.dates import month_number, month_start


@dataclass(frozen=True)
class Series:
    keys: tuple[str, ...]
    time: str = "month"

    def window(self) -> WindowSpec:
        return W.partitionBy(*self.keys).orderBy(self.time)

    def reverse(self) -> WindowSpec:
        return W.partitionBy(*self.keys).orderBy(F.col(self.time).desc())


#: Column that :func:`spread` adds; groups of a spread table are those of (keys, TASK).
TASK = "_task"


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One shuffle by a hash of the key into the session's number of partitions.

    For grouped Python work: its cost is not in its bytes. Rows that already lie by key, after a
    window, would be grouped where they are, and adaptive execution would have merged their
    small partitions until a few tasks do everything. The hash is a column of its own, so that
    this shuffle is neither left out nor merged, and a grouping by the keys and it needs no other.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn(TASK, F.xxhash64(*keys)).repartition(n, TASK)


def as_monthly(df: DataFrame, s: Series) -> DataFrame:
    """Every month from the first to the last of each series; added rows hold NULLs.

    Each row is exploded into itself and the gap that follows it, so the series is
    shuffled once, by its keys, and the windows that come next reuse that layout.
    """
    values = [c for c in df.columns if c not in (*s.keys, s.time)]
    step = F.expr("interval 1 month")
    nxt = F.lead(s.time).over(s.window())
    last = F.when(nxt <= F.col(s.time), F.raise_error(F.lit(f"two rows for one {s.time} in a series")).cast("date")) \
        .otherwise(F.coalesce(F.add_months(nxt, -1), F.col(s.time)))
    filled = df.withColumn("_last", last).withColumn(
        "_month", F.explode(F.sequence(F.col(s.time), F.col("_last"), step)))
    own = F.col("_month") == F.col(s.time)
    return filled.select(
        *s.keys, F.col("_month").alias(s.time),
        *[F.when(own, F.col(c)).alias(c) for c in values],
    )


def lag_rows(df: DataFrame, s: Series, col: str, lags: Sequence[int], prefix: str | None = None) -> DataFrame:
    """Value ``k`` rows earlier in the series; gaps are not counted as rows."""
    name = prefix or f"{col}_lag"
    return df.withColumns({f"{name}_{k}": F.lag(col, k).over(s.window()) for k in lags})


def lag_months(df: DataFrame, s: Series, col: str, lags: Sequence[int], prefix: str | None = None) -> DataFrame:
    """Value ``k`` calendar months earlier, for series with or without gaps."""
    name = prefix or f"{col}_lag"
    w = W.partitionBy(*s.keys).orderBy(month_number(F.col(s.time)))
    return df.withColumns({f"{name}_{k}": F.max(col).over(w.rangeBetween(-k, -k)) for k in lags})


def rolling_past(s: Series, col: str, n: int, how: str) -> Column:
    """Mean or sample deviation of the ``n`` rows before this one; NULL until all are there."""
    w = s.window().rowsBetween(-n, -1)
    value = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum}[how](col).over(w)
    return F.when(F.count(col).over(w) == n, value)


def interpolate(df: DataFrame, s: Series, col: str, out: str | None = None) -> DataFrame:
    """Linear by position inside the series; leading gaps stay, trailing gaps repeat the last
    value. For a monthly series (``as_monthly``) position and month agree."""
    pos = F.row_number().over(s.window())
    seen = F.when(F.col(col).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(col).alias("v")))
    before = F.last(seen, True).over(s.window().rowsBetween(W.unboundedPreceding, 0))
    after = F.last(seen, True).over(s.reverse().rowsBetween(W.unboundedPreceding, 0))
    marked = df.withColumn("_i", pos).withColumn("_a", before).withColumn("_b", after)
    share = F.try_divide(F.col("_i") - F.col("_a.i"), F.col("_b.i") - F.col("_a.i"))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    return marked.withColumn(out or col, F.coalesce(F.col(col), line, F.col("_a.v"))).drop("_i", "_a", "_b")


def fill_forward(s: Series, col: str) -> Column:
    return F.last(col, True).over(s.window().rowsBetween(W.unboundedPreceding, 0))


def fill_backward(s: Series, col: str) -> Column:
    return F.last(col, True).over(s.reverse().rowsBetween(W.unboundedPreceding, 0))


def fill_both(df: DataFrame, s: Series, col: str) -> DataFrame:
    """Forward fill, then backward fill of what is left at the start."""
    return df.withColumn("_f", fill_forward(s, col)).withColumn("_b", fill_backward(s, col)).withColumn(
        col, F.coalesce("_f", "_b")).drop("_f", "_b")


def difference(s: Series, col: str) -> Column:
    return F.col(col) - F.lag(col).over(s.window())


def log_difference(s: Series, col: str) -> Column:
    return F.ln(col) - F.ln(F.lag(col).over(s.window()))


def percent_change(df: DataFrame, s: Series, col: str, out: str) -> DataFrame:
    """Relative change to the previous row, missing values padded forward first. Rows with a
    NULL key have no series and get NULL."""
    filled = df.withColumn("_f", fill_forward(s, col))
    change = F.try_divide(F.col("_f"), F.lag("_f").over(s.window())) - 1
    for k in s.keys:
        change = F.when(F.col(k).isNotNull(), change)
    return filled.withColumn(out, change).drop("_f")


def accumulate(df: DataFrame, s: Series, col: str, scales: Sequence[int], prefix: str) -> DataFrame:
    """Sum over the last ``k`` months for each scale; NULL unless all ``k`` are there.

    The frames range over the month number, so gaps need no filler rows, and all scales
    share one window pass.
    """
    w = W.partitionBy(*s.keys).orderBy("_m")
    out = df.withColumn("_m", month_number(F.col(s.time)))
    cols = {}
    for k in scales:
        frame = w.rangeBetween(-(k - 1), 0)
        cols[f"{prefix}_{k}"] = F.when(F.count(col).over(frame) == k, F.sum(col).over(frame))
    return out.withColumns(cols).drop("_m")


def split_tail(df: DataFrame, s: Series, n: int, out: str = "split") -> DataFrame:
    """Marks the last ``n`` rows of every series as ``test``, the others as ``train``."""
    rank = F.row_number().over(s.reverse())
    return df.withColumn(out, F.when(rank <= n, "test").otherwise("train"))


class EmptySplit(ValueError):
    """One side of a date split has no rows."""


def split_at(df: DataFrame, col: str, first_test_day: str, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows before the day, and rows from it on."""
    day = F.lit(first_test_day).cast("date")
    train, test = df.filter(F.col(col) < day), df.filter(F.col(col) >= day)
    if check and (train.isEmpty() or test.isEmpty()):
        raise EmptySplit(f"no rows on one side of {first_test_day}")
    return train, test


def calendar_features(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns({"month_num": F.month(col), "year_num": F.year(col)})


def with_month(df: DataFrame, date: str = "date", out: str = "month") -> DataFrame:
    return df.withColumn(out, month_start(F.col(date)))
