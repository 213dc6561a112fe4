"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words. Each of its documents is taken ``floor(target / size
of the source)`` times for certain; the rest of the target is a sample of fixed size without
replacement. For it every document draws a uniform number ``u`` from a digest of its id, and
documents are ranked by ``(u / (1 - u)) / odds``, their random odds over their inclusion odds.
The odds are unequal: ``f / (1 - f)`` of the source's remaining fraction ``f``, times the
square root of the document's size, so that fragments repeat less often than whole texts. The
sample is the head of that ranking whose words come nearest to the rest of the target.

No source is sorted in one task. Ranks are cut in two steps: a histogram of words per source
and rank bucket (map-side sums) finds the bucket in which the target is reached, and only that
bucket is ordered. What comes out is one small row per source, its cut; every document then
decides alone whether it lies before the cut of its source. All weights are sums over all rows.

Defined results: null text has size 0 and is never taken; null is a source of its own, the
last one; a source without words has target 0; rows equal in id and size are taken together;
a null id draws like any other id. Other columns pass through ``mixed`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import join_small, text_of, where_computed, words_of, written

P = "__mix_"
#: Weights of the sources in code point order, repeating; words wanted per word there is; most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Ranks per source that are told apart before the exact step.
BUCKETS = 65_536
SEED = "mix"


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn(P + "size", F.size(words_of(text_of())).cast("long"))


def _rank(seed: str) -> Column:
    """Pareto rank of a row that has its size and its source's odds."""
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":" + seed))), 1, 12), 16, 10)
    u = (draw.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return (u / (F.lit(1.0) - u)) / (F.sqrt(F.col(P + "size").cast("double")) * F.col("odds"))


def _ranked(sized: DataFrame, cuts: DataFrame, seed: str) -> DataFrame:
    out = join_small(sized, cuts, ["source"], "left")
    drawn = (F.col("odds") > 0) & (F.col(P + "size") > 0)
    out = out.withColumn(P + "rank", F.when(drawn, _rank(seed)))
    return out.withColumn(P + "bucket", F.floor(F.lit(float(BUCKETS)) * F.col(P + "rank") / (F.lit(1.0) + F.col(P + "rank"))))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> the same with ``target``, ``certain`` copies and ``odds`` of one more.

    Works on one row per source. Targets follow the weights up to ``most`` times the source;
    the level at which the others share the rest is read off the sources in the order in which
    they fill up.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    rows = totals.withColumn("nth", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("nth") % len(weights)))
    rows = rows.withColumn("most", F.lit(most) * F.col("source_size")).withColumn("words", F.lit(share) * F.sum("source_size").over(every))
    filling = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    rows = rows.withColumn("before", F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("left", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("words") - F.col("before")) / F.col("left"))
    rows = rows.withColumn("open", F.col("most") >= F.col("level") * F.col("weight"))
    rows = rows.withColumn("shared", F.max(F.when(F.col("open"), F.col("level"))).over(every))
    own = F.least(F.col("most").cast("double"), F.coalesce(F.col("shared") * F.col("weight"), F.col("most").cast("double")))
    rows = rows.withColumn("target", own)
    rows = rows.withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rows = rows.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
    part = F.col("rest") / F.col("source_size")
    odds = F.when((F.col("source_size") > 0) & (F.col("rest") > 0), part / (F.lit(1.0) - part)).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", "target", "certain", "rest", odds.alias("odds"))


def cuts_of(sized: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per source: its target and where its ranking is cut. ``sized`` is read three times."""
    goals = written(targets(written(sized.groupBy("source").agg(F.sum(P + "size").alias("source_size")), "mix-totals")), "mix-targets")
    ranked = _ranked(sized, goals, seed).where(F.col(P + "bucket").isNotNull())
    words = ranked.groupBy("source", "rest", P + "bucket").agg(F.sum(P + "size").alias("words"))
    running = Window.partitionBy("source").orderBy(P + "bucket")
    words = words.withColumn("upto", F.sum("words").over(running))
    edge = words.where(F.col("upto") > F.col("rest")).groupBy("source").agg(
        F.min(F.struct(F.col(P + "bucket").alias("bucket"), (F.col("upto") - F.col("words")).alias("before"))).alias("edge"))
    edge = written(edge.select("source", F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("before")), "mix-edges")
    # Only the bucket in which the target is reached is put in order.
    inside = join_small(ranked, edge, ["source"]).where(F.col(P + "bucket") == F.col("edge"))
    key = F.struct(F.col(P + "rank").alias("rank"), F.col("doc_id").alias("id"), F.col(P + "size").alias("size"))
    order = Window.partitionBy("source").orderBy(key.asc())
    inside = inside.withColumn("upto", F.col("before") + F.sum(P + "size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # The document at the edge is taken if that brings the source nearer to its target.
    last = inside.where(F.col("upto") - F.col(P + "size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(key).alias("last"))
    last, rim = last.withColumnRenamed("source", "s1"), edge.withColumnRenamed("source", "s2")
    out = goals.join(rim, goals["source"].eqNullSafe(rim["s2"]), "left").join(last, goals["source"].eqNullSafe(last["s1"]), "left")
    return written(out.select(*goals.columns, "edge", "last"), "mix-cuts")


def with_copies(sized: DataFrame, cuts: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds ``__mix_copies`` and the source's figures to every row."""
    ranked = _ranked(sized, cuts, seed)
    key = F.struct(F.col(P + "rank").alias("rank"), F.col("doc_id").alias("id"), F.col(P + "size").alias("size"))
    bucket = F.col(P + "bucket")
    extra = bucket.isNotNull() & (F.col("edge").isNull() | (bucket < F.col("edge")) | (
        (bucket == F.col("edge")) & F.coalesce(key <= F.col("last"), F.lit(False))))
    return ranked.withColumn(P + "copies", F.when(F.col(P + "size") > 0, F.col("certain") + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(0))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's figures, and the words the mix takes of it."""
    narrow = written(_sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes")
    out = with_copies(narrow, cuts_of(narrow))
    return out.select("doc_id", F.col(P + "size").alias("size"), "source_size", "target",
                      (F.col(P + "copies") * F.col(P + "size")).alias("taken"), F.col(P + "copies").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of the input."""
    narrow = written(_sized(docs.select("doc_id", "source", "text")).drop("text"), "mix-sizes")
    held = docs.select(F.struct(*docs.columns).alias(P + "row"), "doc_id", "source", "text")
    held = _sized(held).drop("text")
    out = where_computed(with_copies(held, cuts_of(narrow)), F.col(P + "copies") > 0)
    out = out.select(P + "row", F.explode(F.sequence(F.lit(1), F.col(P + "copies").cast("int"))))
    return out.select(P + "row.*")


def copies_sql(source: str = "documents") -> str:
    """DuckDB SQL over one sorted ranking per source; the same columns as :func:`report`."""
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM {source}),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
a AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth, CAST({MOST} * source_size AS DOUBLE) AS most,
             {SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS words FROM totals),
b AS (SELECT *, ([{weights}])[1 + nth % {len(WEIGHTS)}] AS weight FROM a),
c AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CAST(sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS remain FROM b),
d AS (SELECT *, (words - before) / remain AS level FROM c),
e AS (SELECT *, least(most, coalesce(max(CASE WHEN most >= level * weight THEN level END) OVER () * weight, most)) AS target FROM d),
f AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS certain FROM e),
g AS (SELECT *, target - certain * source_size AS rest FROM f),
h AS (SELECT *, CASE WHEN source_size > 0 AND rest > 0 THEN (rest / source_size) / (1.0::DOUBLE - rest / source_size) ELSE 0 END AS odds FROM g),
r AS (SELECT s.doc_id, s.size, h.*, (CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), 'null') || ':{SEED}'), 1, 12) AS BIGINT)::DOUBLE + 0.5::DOUBLE)
             / 281474976710656::DOUBLE AS u
      FROM sized s JOIN h ON s.source IS NOT DISTINCT FROM h.source),
q AS (SELECT *, CASE WHEN odds > 0 AND size > 0 THEN (u / (1.0::DOUBLE - u)) / (sqrt(size::DOUBLE) * odds) END AS rank FROM r),
t AS (SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (SELECT *, CASE WHEN size > 0 THEN certain + CASE WHEN rank IS NOT NULL AND upto - size / 2 <= rest THEN 1 ELSE 0 END ELSE 0 END AS copies FROM t)"""
