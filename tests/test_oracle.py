"""Every registered query with check SQL, row for row.

The middle scale is used: on the smallest one some index fits rest on two nearly equal
years, which pins scores to 1 and leaves their last digits to rounding.
"""

import pytest

from granary.plans import catalogue, registry
from tests.compare import differences, duck, plain

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in catalogue.QUERIES.items() if q.sql])
def test_matches_check_sql(spark, con, name):
    q = catalogue.QUERIES[name]
    ours = registry.run(name, spark, FOLDER).toPandas()
    check = con.execute(registry.oracle(q.columns, q.sql)).fetchdf()
    assert differences(plain(ours), plain(check)) is None
