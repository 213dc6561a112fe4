"""Joins of many rows with a small table of one row per key."""

from __future__ import annotations

from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which the small side is broadcast, and copies of it beyond.
BROADCAST_ROWS = 200_000
SALTS = 32


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left",
           bound: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """``df`` with the columns of ``table``, which has at most one row per key.

    The table is computed once, kept, and counted. Up to ``bound`` rows it is broadcast, so the many
    rows stay where they are. Beyond that both sides are shuffled on key and salt, so that a key
    that holds a large part of the rows is spread over ``salts`` tasks. A NULL in a key
    matches nothing: such rows take no part in the join and, with ``how="left"``, come out with NULLs.
    """
    if how not in ("left", "inner"):
        raise ValueError("a lookup is left or inner")
    table = table.dropna(subset=list(keys)).persist(StorageLevel.MEMORY_AND_DISK)
    small = table.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    same = [F.col(k) == F.col(f"_key_{i}") for i, k in enumerate(keys)]
    names = [f"_key_{i}" for i in range(len(keys))]
    if table.count() <= bound:
        return df.join(F.broadcast(small), same, how).drop(*names)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = df.filter(known).withColumn("_own", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    out = own.join(salted, [*same, F.col("_own") == F.col("_salt")], how).drop(*names, "_salt", "_own")
    return out.unionByName(df.filter(~known), allowMissingColumns=True) if how == "left" else out
