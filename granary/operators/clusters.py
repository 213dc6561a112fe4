"""Markets grouped by their price changes."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.functions.numeric import pair_count, safe_corr
from granary.operators.quantiles import exact_quantiles
from granary.operators.series import Series, fill_both
from granary.operators.summary import well_observed
from granary.sources.tables import kept

# Cluster counts and the fewest observations of a market.
SEED = 42
SWEEP = tuple(range(2, 15))
FINAL_K = 15
RATE_K = 10
MIN_OBSERVATIONS = 20
#: Vectors of markets a task holds.
TOGETHER = 8192
#: Rounds of Lloyd's method, at most.
ROUNDS = 100


def dense_series(df: DataFrame, key: str, time: str, value: str, min_n: int = MIN_OBSERVATIONS) -> DataFrame:
    """Mean value per market and month for markets with enough months, on the months of the
    whole table, gaps filled forward and then backward."""
    means = df.dropna(subset=[key, time]).groupBy(key, time).agg(F.avg(value).alias(value))
    # The means are read for their counts, for the calendar, for the markets and for themselves.
    means = kept(well_observed(kept(means, "market-months"), [key], value, min_n), "observed-months")
    first, last = means.agg(F.min(time)).scalar(), means.agg(F.max(time)).scalar()
    frame = means.select(key).distinct().select(
        key, F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias(time))
    return fill_both(frame.join(means, [key, time], "left"), Series((key,), time), value)


def standardise_by_date(df: DataFrame, time: str, value: str, out: str = "z") -> DataFrame:
    """Z-score across the markets of one month (population deviation, constant months 0).

    The moments are aggregated and joined back: a month has as many rows as there are
    markets, too many for a window at scale.
    """
    m = df.groupBy(time).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") > 0, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).otherwise(F.lit(0.0))
    return df.join(m, [time]).withColumn(out, z).drop("_m", "_s")


def market_vectors(df: DataFrame, key: str, time: str, z: str = "z") -> DataFrame:
    """One vector per market, its values in date order; as long as the calendar. Markets lie in order of their key."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(time), F.col(z)))), lambda s: s[z])
    vectors = kept(df.groupBy(key).agg(ordered.alias("_a")), "vectors").select(key, array_to_vector("_a").alias("features"))
    # Each task of each round of each fit sends sums to the driver: as few tasks as the vectors need, not one per shuffle partition.
    return vectors.repartitionByRange(-(-vectors.count() // TOGETHER) or 1, key).sortWithinPartitions(key)


def kmeans(k: int, **params) -> KMeans:
    return KMeans(k=k, seed=SEED, predictionCol="cluster", featuresCol="features", maxIter=100, **params)


def sweep(vectors: DataFrame, ks: Sequence[int] = SWEEP, parallelism: int = 4) -> DataFrame:
    """Inertia and mean silhouette (squared Euclidean) per number of clusters."""
    spark = vectors.sparkSession
    vectors = vectors.persist()
    try:
        scorer = ClusteringEvaluator(predictionCol="cluster", featuresCol="features")

        def one(k: int):
            model = kmeans(k).fit(vectors)
            used = len({tuple(c) for c in model.clusterCenters()})
            silhouette = float(scorer.evaluate(model.transform(vectors))) if used > 1 else None
            return k, float(model.summary.trainingCost), silhouette

        vectors.count()
        with ThreadPoolExecutor(parallelism) as pool:
            rows = list(pool.map(one, ks))
    finally:
        vectors.unpersist()
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double")


def assign(vectors: DataFrame, key: str, k: int = FINAL_K) -> DataFrame:
    return kmeans(k).fit(vectors).transform(vectors).select(key, "cluster")


def membership(labels: DataFrame, markets: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Cluster labels with the distinct attributes of the markets."""
    return labels.join(markets.select(key, *attributes).dropDuplicates(), [key], "left")


def interval_of(value: Column, centres: Sequence[float]) -> Column:
    """Number of the nearest of ascending centres; half way between two, the lower one."""
    cuts = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    # One constant array, so that the rounds share their generated code.
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: cut < value))


def line_centres(df: DataFrame, col: str, k: int, rounds: int = ROUNDS) -> list[float]:
    """Ascending centres of single numbers: Lloyd's rounds from the middles of ``k`` equal shares of the rows.

    On a line a cluster is an interval, so a round only needs count and sum between neighbouring
    middles. Values are counted once; a round is one aggregation of those counts with partial
    sums, and ``k`` numbers come back. Empty intervals are given up.
    """
    shares = {f"q{i}": (i + 0.5) / k for i in range(k)}
    first = exact_quantiles(df, [], col, shares).first()
    centres = sorted({first[n] for n in shares if first[n] is not None}) if first else []
    counted = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_x")).agg(F.count(F.lit(1)).alias("_c")).persist()
    for _ in range(rounds):
        sums = counted.groupBy(interval_of(F.col("_x"), centres).alias("i")).agg(
            (F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("mean")).collect()
        moved = sorted(r["mean"] for r in sums)
        still = len(moved) == len(centres) and all(abs(a - b) <= 1e-12 * (centres[-1] - centres[0]) for a, b in zip(moved, centres))
        centres = moved
        if still:
            break
    counted.unpersist()
    return centres


def rate_clusters(df: DataFrame, rate: str, k: int = RATE_K) -> DataFrame:
    """Clusters of single change rates, numbered from the lowest centre."""
    rows = kept(df.dropna(subset=[rate]), "rates")
    return rows.withColumn("cluster", interval_of(F.col(rate), line_centres(rows, rate, k)))


def cluster_statistics(series: DataFrame, labels: DataFrame, key: str, value: str) -> DataFrame:
    """Level, volatility and extremes of each cluster from the statistics of its markets."""
    per_market = series.groupBy(key).agg(
        F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.max(value).alias("hi"), F.min(value).alias("lo"))
    return per_market.join(labels.select(key, "cluster"), [key]).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_markets"), F.avg("m").alias("mean_inflation"), F.avg("s").alias("std_inflation"),
        F.max("hi").alias("max_spike"), F.min("lo").alias("min_drop"), F.stddev_samp("s").alias("volatility"))


def cluster_mean_series(series: DataFrame, labels: DataFrame, key: str, time: str, value: str) -> DataFrame:
    return series.join(labels.select(key, "cluster"), [key]).groupBy("cluster", time).agg(
        F.avg(value).alias("cluster_mean"))


def cluster_correlation(series: DataFrame, labels: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Correlation of each series with the mean series of its cluster: one row per series and cluster.

    The means are small (clusters times months); no two series are paired.
    """
    means = cluster_mean_series(series, labels, key, time, value)
    rows = series.join(labels.select(key, "cluster"), [key]).join(means, ["cluster", time])
    x, y = F.col(value), F.col("cluster_mean")
    return rows.groupBy("cluster", key).agg(pair_count(x, y).alias("n"), safe_corr(x, y).alias("corr"))


def composition(members: DataFrame, country: str = "countryiso3") -> DataFrame:
    """Markets per cluster and country with their share of the cluster."""
    counts = members.groupBy("cluster", country).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("cluster"))
    return counts.withColumn("share", F.try_divide(F.col("n"), total))
