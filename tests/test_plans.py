"""Plan shape: no cross joins, no window over everything, pruned scans."""

import re

import pytest

from granary.plans import catalogue, registry
from granary.plans.inputs import Inputs

FOLDER = "/root/testdata/sf0.001"
#: Fitting happens while these are built, and they write no plan of their own.
FITTED = {n for n in catalogue.QUERIES if re.match(r"h1[3-6]_|h2[1-3]_|h24_example", n)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in FITTED])
def test_no_cross_join_and_no_global_window(spark, name):
    text = plan_of(registry.run(name, spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", text):
        first = spec.split(",")[0]
        assert " ASC" not in first and " DESC" not in first, f"window without a partition: {spec}"


def test_scan_reads_only_needed_columns(spark):
    text = plan_of(registry.run("d1_monthly_mean_price", spark, FOLDER))
    lineitem = [line for line in text.splitlines() if "lineitem.parquet" in line]
    assert lineitem and all("l_tax" not in line and "l_comment" not in line for line in lineitem)


def test_index_is_one_shuffle_by_cell(spark):
    from granary.operators.index import spi
    grid = Inputs(spark, FOLDER).grid_precip.persist()
    grid.count()
    text = plan_of(spi(grid))
    grid.unpersist()
    outside = text.split("InMemoryTableScan")[0]
    assert outside.count("Exchange") == 1, outside
