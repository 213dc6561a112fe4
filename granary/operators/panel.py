"""Joins, groupings and reshaping that build monthly panels."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.names import commodity_group, names_any, unit_weight
from granary.operators.quantiles import exact_quantiles


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a missing group key belong to no group."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def price_per_kg(df: DataFrame, mode: str = "first_number") -> DataFrame:
    """Adds the unit weight and the price for one kg (NULL for weight 0)."""
    return df.withColumn("weight_kg", unit_weight(F.col("unit"), mode).cast("double")).withColumn(
        "price_per_kg", F.try_divide("usdprice", "weight_kg"))


def positive_weight(df: DataFrame) -> DataFrame:
    return df.filter(F.col("weight_kg") > 0)


def normalise_sacks(df: DataFrame) -> DataFrame:
    """Prices of 100 kg sacks to one kg; every other unit is left as it is."""
    sack = F.coalesce(F.col("unit") == "100 KG", F.lit(False))
    return df.withColumns({
        "usdprice": F.when(sack, F.col("usdprice") / 100.0).otherwise(F.col("usdprice")),
        "unit": F.when(sack, F.lit("KG")).otherwise(F.col("unit")),
    })


def only_commodities(df: DataFrame, targets: Sequence[str], name: str = "commodity") -> DataFrame:
    return df.filter(names_any(F.col(name), targets))


def without(df: DataFrame, pattern: str, name: str = "commodity") -> DataFrame:
    return df.filter(~F.col(name).rlike("(?i)" + pattern))


def group_commodities(df: DataFrame, targets: Sequence[str], ignore_case: bool = False) -> DataFrame:
    return df.withColumn("commodity_group", commodity_group(F.col("commodity"), targets, ignore_case))


def only_groups(df: DataFrame, targets: Sequence[str], ignore_case: bool = False) -> DataFrame:
    """As ``group_commodities``, without the rows that have no name and so no group.

    The group then cannot be NULL, and a later test of the group key is not pushed down as a
    copy of the whole expression, which would work out the name once per target.
    """
    named = with_keys(df, ["commodity"])
    group = commodity_group(F.col("commodity"), targets, ignore_case)
    return named.withColumn("commodity_group", F.coalesce(group, F.lit("")))


def mean_by(df: DataFrame, keys: Sequence[str], col: str, out: str | None = None) -> DataFrame:
    return with_keys(df, keys).groupBy(*keys).agg(F.avg(col).alias(out or col))


def median_by(df: DataFrame, keys: Sequence[str], col: str, out: str | None = None) -> DataFrame:
    """Exact median; see ``quantiles`` for how a hot group is spread over tasks."""
    return exact_quantiles(with_keys(df, keys), keys, col, {out or col: 0.5})


def mean_by_month(df: DataFrame, keys: Sequence[str], col: str, out: str, time: str = "time") -> DataFrame:
    """Mean over all cells of an area and month, from sums and counts of the non-null cells."""
    monthly = df.withColumn("month", F.trunc(time, "MM"))
    by = [*keys, "month"]
    parts = with_keys(monthly, by).groupBy(*by).agg(
        F.sum(col).alias("total"), F.count(col).alias("n_cells"))
    return parts.select(*by, F.try_divide("total", "n_cells").alias(out), "n_cells")


def centroids(df: DataFrame, keys: Sequence[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    return with_keys(df, keys).groupBy(*keys).agg(F.avg(lat).alias(lat), F.avg(lon).alias(lon))


def pivot_mean(df: DataFrame, keys: Sequence[str], col: str, values: Sequence, value: str,
               prefix: str) -> DataFrame:
    """One column per listed value, mean on duplicates, as one grouped aggregation.

    The list is given, so Spark runs no extra job to find it.
    """
    cols = [F.avg(F.when(F.col(col) == F.lit(v), F.col(value))).alias(f"{prefix}{v}") for v in values]
    return with_keys(df, keys).groupBy(*keys).agg(*cols)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join. Sizes are not known here, so broadcasting is left to the measured sizes
    that adaptive execution sees."""
    return left.join(right, list(keys), how)


def outer_join_all(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of many tables; value columns keep their names."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), tables)


def keep_members(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(members.select(*keys), list(keys), "left_semi")


def top_groups(df: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """The ``n`` groups with the largest total, ties by name."""
    return (df.groupBy(key).agg(F.sum(weight).alias("total"))
            .orderBy(F.col("total").desc(), key).limit(n))


def best_row(df: DataFrame, keys: Sequence[str], score: Column, ties: Sequence[str],
             largest: bool = True) -> DataFrame:
    """The row with the largest (smallest) score of each group; ties go to the smallest
    ``ties`` values. One aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    if largest:
        score = -score
    order = F.struct(score.alias("_score"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    best = F.min_by(F.struct(*rest), order)
    return df.filter(score.isNotNull()).groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def first_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """First non-null value per column and group, which may come from different rows."""
    by = F.struct(*order)
    return with_keys(df, keys).groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in cols])


def unit_audit(df: DataFrame, mode: str = "first_number") -> DataFrame:
    """Per distinct unit: parsed weight, rows, whether it fell back to 1 or names no kg."""
    w = unit_weight(F.col("unit"), mode).cast("double")
    units = df.groupBy("unit").agg(F.count(F.lit(1)).alias("n_rows"))
    return units.select(
        "unit", w.alias("weight_kg"), "n_rows", (w == 1.0).alias("defaulted"),
        (~F.contains(F.upper(F.coalesce("unit", F.lit(""))), F.lit("KG"))).alias("no_kg"),
        (w <= 0).alias("not_positive"),
    )


def defaulted_unit_users(df: DataFrame, mode: str = "first_number") -> DataFrame:
    """Commodities sold in units that fell back to weight 1, one row per pair."""
    w = unit_weight(F.col("unit"), mode).cast("double")
    return df.filter(F.col("unit").isNotNull() & (w == 1.0)).select("unit", "commodity").distinct()


def key_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which side each distinct key occurs on: ``both``, ``left`` or ``right``."""
    a = with_keys(left, keys).select(*keys).distinct().withColumn("_a", F.lit(True))
    b = with_keys(right, keys).select(*keys).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "left").otherwise("right")
    return a.join(b, list(keys), "full").select(*keys, side.alias("side"))
