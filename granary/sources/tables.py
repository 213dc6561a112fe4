"""Readers and writers: price, index and sheet tables."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType, DoubleType, LongType, StringType, StructField, StructType,
)

from granary.functions.numeric import nan_to_null, null_if_nan
from granary.session import shared_folder

PRICE_SCHEMA = StructType([
    StructField("countryiso3", StringType()),
    StructField("admin1", StringType()),
    StructField("admin2", StringType()),
    StructField("market_id", LongType()),
    StructField("market", StringType()),
    StructField("latitude", DoubleType()),
    StructField("longitude", DoubleType()),
    StructField("date", DateType()),
    StructField("commodity", StringType()),
    StructField("unit", StringType()),
    StructField("usdprice", DoubleType()),
])

GRID_SCHEMA = StructType([
    StructField("lat", DoubleType()),
    StructField("lon", DoubleType()),
    StructField("time", DateType()),
    StructField("precip", DoubleType()),
])

#: Spellings of the grid columns found in practice.
GRID_COLUMNS = {
    "longitude": "lon", "latitude": "lat", "x": "lon", "y": "lat",
    "precipitation": "precip", "precipitation_amount": "precip",
}

#: Positions in the monthly index sheet and its first data row.
SHEET_START = "1960M01"
SHEET_COLUMNS = {0: "date", 2: "energy_index", 6: "food_index", 12: "fertilizer_index"}


class MissingColumns(ValueError):
    """The input lacks columns the analysis needs."""


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise MissingColumns(f"missing columns {absent}; found {df.columns}")
    return df


def conform(df: DataFrame, schema: StructType, colmap: Mapping[str, str] | None = None) -> DataFrame:
    """Rename by ``colmap`` (theirs -> ours), check, prune to the schema, cast, NaN to NULL."""
    df = df.withColumnsRenamed(dict(colmap or {}))
    require_columns(df, schema.names)
    cast = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    return nan_to_null(cast)


def read_csv(spark: SparkSession, path: str, schema: StructType,
             colmap: Mapping[str, str] | None = None) -> DataFrame:
    """CSV with a header line. Every cell is read as text and only the wanted ones are
    cast, so column order and extra columns do not matter and nothing is inferred."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.withColumnsRenamed(dict(colmap or {}))
    require_columns(raw, schema.names)

    def typed(f: StructField):
        c = F.col(f.name).try_cast(f.dataType)
        return (null_if_nan(c) if isinstance(f.dataType, DoubleType) else c).alias(f.name)

    return raw.select(*[typed(f) for f in schema])


def read_prices(spark: SparkSession, path: str, colmap: Mapping[str, str] | None = None) -> DataFrame:
    """Price observations from CSV (``*.csv``) or Parquet."""
    if path.rstrip("/").endswith(".csv"):
        return read_csv(spark, path, PRICE_SCHEMA, colmap)
    return conform(spark.read.parquet(path), PRICE_SCHEMA, colmap)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_existing(spark: SparkSession, paths: Sequence[str],
                  required: Sequence[str] = ()) -> DataFrame:
    """Stack the Parquet tables that exist; name those that do not in a log line."""
    found = [p for p in paths if path_exists(spark, p)]
    for p in sorted(set(paths) - set(found)):
        print(f"skipped, not found: {p}")
    if not found:
        raise FileNotFoundError(f"none of {list(paths)} exists")
    out = None
    for p in found:
        df = require_columns(spark.read.parquet(p), required)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def normalise_grid_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(GRID_COLUMNS)


def read_sheet(df: DataFrame, row: str = "rn", start: str = SHEET_START,
               columns: Mapping[int, str] = SHEET_COLUMNS) -> DataFrame:
    """Cut an untyped sheet: from the row whose first cell is ``start``, keep some columns.

    ``df`` has text columns ``c0, c1, ...`` and a row number. Rows without a first cell go.
    """
    first = df.filter(F.col("c0") == start).agg(F.min(row)).scalar()
    kept = df.filter((F.col(row) >= first) & F.col("c0").isNotNull())
    return kept.select(F.col(row), *[F.col(f"c{i}").alias(n) for i, n in columns.items()])


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Written table at ``path``: reused where it is complete, computed and saved otherwise.

    The path lies in shared storage, so the result also survives the loss of executors.
    """
    spark = df.sparkSession
    if not path_exists(spark, path.rstrip("/") + "/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder, for plans that read it several times."""
    return materialize(df, f"{shared_folder(df.sparkSession)}/{name}")
