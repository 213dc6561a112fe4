"""Named queries and the SQL each is checked against.

A query lists its output columns once. The same list shapes the Spark result and the check
SQL: ``name`` is passed through, ``name:d`` is a date shown as text, ``name:6`` a double
rounded to six digits (the two engines add in different orders). The rounding boundary lies
a little off the middle between two decimals: prices are decimals, so their means often end
in an exact half, which the last bit of a sum would push either way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.inputs import TABLES, VIEWS, Inputs, shapes_sql


@dataclass(frozen=True)
class Query:
    build: Callable[[Inputs], DataFrame]
    columns: str
    sql: str | None = None


ROUND_AT = 0.50371

QUERIES: dict[str, Query] = {}
CTES: dict[str, str] = {k: v.format(**{t: t for t in TABLES}) for k, v in VIEWS.items()}
CTES["area_segments"] = shapes_sql()


def query(name: str, columns: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(build, columns, sql)
        return build
    return register


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _pairs(columns: str) -> list[tuple[str, str]]:
    return [(c.partition(":")[0], c.partition(":")[2]) for c in columns.split()]


def present(df: DataFrame, columns: str) -> DataFrame:
    def shown(name: str, form: str):
        c = F.col(name)
        if form == "d":
            c = c.cast("date").cast("string")
        elif form:
            unit = 10.0 ** int(form)
            c = F.floor(c.cast("double") * F.lit(unit) + F.lit(ROUND_AT)) / F.lit(unit)
        return c.alias(name)
    return df.select(*[shown(n, f) for n, f in _pairs(columns)])


def _present_sql(columns: str) -> str:
    def shown(name: str, form: str) -> str:
        if form == "d":
            return f"CAST(CAST({name} AS DATE) AS VARCHAR) AS {name}"
        if form:
            unit = f"CAST(1e{form} AS DOUBLE)"
            return f"floor(CAST({name} AS DOUBLE) * {unit} + CAST({ROUND_AT} AS DOUBLE)) / {unit} AS {name}"
        return name
    return ", ".join(shown(n, f) for n, f in _pairs(columns))


def _needed(sql: str, found: list[str]) -> list[str]:
    """CTEs the text refers to, each after those it refers to itself."""
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            _needed(body, found)
            if name not in found:
                found.append(name)
    return found


def oracle(columns: str, sql: str) -> str:
    used = _needed(sql, [])
    head = "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in used) + "\n" if used else ""
    return f"{head}SELECT {_present_sql(columns)} FROM (\n{sql}\n) result"


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    q = QUERIES[name]
    return present(q.build(Inputs(spark, folder)), q.columns)
