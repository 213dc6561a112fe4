"""What the text operators share: word columns, written intermediates, measured broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import shared_folder

#: The six ASCII blanks; every other character belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only if its counted rows stay under this.
BROADCAST_ROWS = 100_000
#: Rows of a batch that a worker holds as Python objects at a time.
PART_ROWS = 512
#: Copies of the small side when both sides are shuffled on a key that may be hot.
SALTS = 32


def text_of(column: str = "text") -> Column:
    """The whole text; a null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words between ASCII blanks, unchanged, in order."""
    return F.filter(F.split(text, BLANK_RUN, -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}-{name}-{uuid.uuid4().hex[:8]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage: a later stage that loses an executor rereads the files instead of
    computing their content again.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of at most ``rows``.

    Spark cuts batches by 10,000 rows; what a worker makes of a row (its text, sets, bitmaps, ids) is many times
    the row, and memory once taken stays with the worker. What Arrow has freed goes back after each batch.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()


class Scratch:
    """Written intermediates of one operator, given back once its own result is written.

    A folder is emptied by writing no rows over it, which works wherever Spark can write.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`written`."""
        self.paths.append(new_folder(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def release(self) -> None:
        nothing = self.spark.range(0).coalesce(1)
        for path in self.paths:
            nothing.write.mode("overwrite").parquet(path)
        self.paths = []


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that fulfil a condition on columns that are costly to compute.

    The optimizer would push the condition below the projections it rests on and compute their
    nested expressions again inside it, once per mention. A row number, which is not
    deterministic, keeps the filter above them.
    """
    name = "__row"
    while name in df.columns:
        name += "_"
    numbered = df.withColumn(name, F.monotonically_increasing_id())
    return numbered.where(condition & (F.col(name) >= 0)).drop(name)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
               bound: int = BROADCAST_ROWS) -> DataFrame:
    """Joins rows of any size with a table of one row per key.

    ``small`` must be cheap to count (a written table). Up to ``bound`` rows it is broadcast;
    beyond that each of its rows is copied once per salt and both sides are shuffled on key
    and salt, so that a key with a third of all rows is spread over ``SALTS`` tasks. Keys
    compare null-safe. ``how`` is inner or left; the result is the same on either way.
    """
    renamed = small.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    if small.count() <= bound:
        on = [big[k].eqNullSafe(renamed[f"__key_{k}"]) for k in keys]
        out = big.join(F.broadcast(renamed), on, how)
        return out.drop(*[f"__key_{k}" for k in keys])
    salted = renamed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = big.withColumn("__own_salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS)).cast("int"))
    on = [left[k].eqNullSafe(salted[f"__key_{k}"]) for k in keys] + [left["__own_salt"] == salted["__salt"]]
    return left.join(salted, on, how).drop("__salt", "__own_salt", *[f"__key_{k}" for k in keys])
