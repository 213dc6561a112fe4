"""Session settings the operators are written for."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession

#: Runtime settings that hold at any data size. ANSI mode stays at its default (on).
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    # One task is one core: linear algebra must not start threads of its own.
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        os.environ.setdefault(name, "1")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("granary")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(1)
def _local_folder() -> str:
    """One temporary folder a process; the setting itself cannot be changed in a running session."""
    return tempfile.mkdtemp(prefix="granary-")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder for written tables below ``spark.checkpoint.dir``.

    The cluster names a folder all executors can reach. Where it names none, only a session
    whose tasks all run on this machine may fall back on a temporary folder; any other one
    gets an error, because executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return os.path.join(base, "granary-" + uuid.uuid4().hex)
