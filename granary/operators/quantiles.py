"""Exact quantiles that do not gather a group.

Spark's exact ``percentile`` keeps every distinct value of a group in one buffer, which a
group holding a third of all rows would overflow. Here the rows are read once and counted by
(group, value); everything after works on that table. Groups of few values are ranked by a
window. In the others the rank is selected: values fall into equal bins between the group's
least and greatest, counts per bin give the bin that holds the rank, and only that bin's
values are looked at again, in finer bins.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Distinct values up to which a group is ranked by one window.
WINDOW_VALUES = 200_000
#: Bins of one round of selection, and rounds before the values left in a bin are ranked.
BINS, ROUNDS = 4096, 3


def _bin(x: Column, low: Column, high: Column) -> Column:
    """Bin of a value between two others; halves keep their difference finite. Infinite ends leave
    all finite values in one bin, which the next round takes apart."""
    share = F.try_divide(x / 2 - low / 2, high / 2 - low / 2)
    return F.when((x == low) | share.isNull(), 0).when(F.isnan(share), BINS - 1).otherwise(
        F.least(F.floor(share * BINS), F.lit(BINS - 1))).cast("int")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys, null or not. (Plain equality would add a filter on one side and keep both from sharing the count.)"""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_{k}"])
    return on


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Mapping[str, float],
                    window_values: int = WINDOW_VALUES) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``probs``.

    Groups whose values are all NULL come out with NULL. Groups of more than ``window_values``
    distinct values are selected in rounds; the result is the same.
    """
    if not keys:
        # One group: a constant key keeps the joins equi-joins.
        whole = df.select(F.lit(1).alias("_all"), F.col(col))
        return exact_quantiles(whole, ["_all"], col, probs, window_values).drop("_all")
    ks = [f"_g{i}" for i in range(len(keys))]
    x = F.col("_x")
    counted = df.select(*[F.col(k).alias(g) for k, g in zip(keys, ks)], F.col(col).cast("double").alias("_x")).groupBy(
        *ks, "_x").agg(F.sum(F.when(x.isNotNull(), 1).otherwise(0)).alias("_c"), F.max("_x").alias("_m"))
    # The value as an aggregate: a filter on it stays above the count, so that all readers share one. (0 has one sign, as in a key.)
    counted = counted.select(*ks, (F.col("_m") + F.lit(0.0)).alias("_x"), "_c")
    sizes = counted.groupBy(*ks).agg(F.sum("_c").alias("_n"), F.count("_x").alias("_v"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    sizes = sizes.select(*[F.col(g).alias(f"_{g}") for g in ks], "_n", "_v", "_low", "_high")
    ranks = {n: (F.col("_n") - 1) * F.lit(float(p)) for n, p in probs.items()}

    few = sizes.filter(F.col("_v") <= window_values).select(*[f"_{g}" for g in ks], "_n")
    w = W.partitionBy(*ks).orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    running = counted.join(few, _same(counted, few, ks)).withColumn("_end", F.sum("_c").over(w))
    start = F.col("_end") - F.col("_c")
    at = lambda rank: F.max(F.when((start <= rank) & (rank < F.col("_end")), x))
    ranked = running.groupBy(*ks).agg(*[v.alias(f"{n}:{side}") for n, r in ranks.items() for side, v in (
        ("low", at(F.floor(r))), ("high", at(F.ceil(r))), ("part", F.max(r - F.floor(r))))])

    many = sizes.filter(F.col("_v") > window_values)
    selected = _selected(counted, many, ks, {f"{n}:{side}": f(r) for n, r in ranks.items() for side, f in (("low", F.floor), ("high", F.ceil))})
    sides = selected.groupBy(*ks).agg(F.max("_n").alias("_n"), *[
        F.max(F.when(F.col("_q") == f"{n}:{side}", x)).alias(f"{n}:{side}") for n in probs for side in ("low", "high")])
    sides = sides.withColumns({f"{n}:part": r - F.floor(r) for n, r in ranks.items()}).select(ranked.columns)
    both = sides.unionByName(ranked)
    value = lambda n: F.col(f"`{n}:low`") + (F.col(f"`{n}:high`") - F.col(f"`{n}:low`")) * F.col(f"`{n}:part`")
    return both.select(*[F.col(g).alias(k) for g, k in zip(ks, keys)], *[value(n).alias(n) for n in probs])


def _selected(counted: DataFrame, many: DataFrame, ks: Sequence[str], wanted: Mapping[str, Column]) -> DataFrame:
    """Rows of (group, _q, _n, _x): the value at each wanted rank of the groups in ``many``."""
    values = counted.filter(F.col("_x").isNotNull())
    holds = lambda rank, start, end: (start <= rank) & (rank < end)

    # The first round is the same for all ranks of a group.
    binned = values.join(many, _same(values, many, ks)).withColumn("_bin", _bin(F.col("_x"), F.col("_low"), F.col("_high")))
    bins = binned.groupBy(*ks, "_bin").agg(F.sum("_c").alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.max("_n").alias("_n"))
    end = F.sum("_c").over(W.partitionBy(*ks).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
    ranks = F.array(*[F.struct(F.lit(q).alias("_q"), r.cast("long").alias("_rank")) for q, r in wanted.items()])
    bins = bins.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_c")).select(
        *ks, "_low", "_high", "_n", "_start", "_end", F.inline(ranks))
    bins = bins.filter(holds(F.col("_rank"), F.col("_start"), F.col("_end")))

    def inside(bins: DataFrame) -> DataFrame:
        targets = bins.select(*[F.col(g).alias(f"_{g}") for g in ks], "_q", "_low", "_high", "_n", (F.col("_rank") - F.col("_start")).alias("_rank"))
        return values.join(targets, _same(values, targets, ks) & F.col("_x").between(F.col("_low"), F.col("_high")))

    for _ in range(ROUNDS - 1):
        binned = inside(bins).withColumn("_bin", _bin(F.col("_x"), F.col("_low"), F.col("_high")))
        bins = binned.groupBy(*ks, "_q", "_bin").agg(
            F.sum("_c").alias("_c"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.max("_n").alias("_n"), F.max("_rank").alias("_rank"))
        end = F.sum("_c").over(W.partitionBy(*ks, "_q").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
        bins = bins.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_c")).filter(
            holds(F.col("_rank"), F.col("_start"), F.col("_end")))
    last = W.partitionBy(*ks, "_q").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    rows = inside(bins).withColumn("_end", F.sum("_c").over(last))
    return rows.filter(holds(F.col("_rank"), F.col("_end") - F.col("_c"), F.col("_end"))).select(*ks, "_q", "_n", "_x")
