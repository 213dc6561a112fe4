"""Seconds of the headline queries in Spark and of their check SQL in DuckDB, one after the other on one machine.

``python tests/baseline.py FOLDER`` prints a Markdown table. Spark computes each query in full without
bringing rows to the driver; DuckDB writes its result into a temporary table, with as many threads.
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE, timed_in  # noqa: E402
from granary.plans import registry  # noqa: E402
from granary.plans.catalogue import QUERIES  # noqa: E402
from granary.session import local_session  # noqa: E402
from tests.compare import duck  # noqa: E402

if __name__ == "__main__":
    folder, cores = sys.argv[1], 8
    spark, con = local_session(cores, cores), duck(folder)
    con.execute(f"SET threads = {cores}")
    timed_in(spark, "d12_unit_counts", folder)
    print("| Query | Spark s | DuckDB s | ratio |\n|---|---|---|---|")
    for name in HEADLINE:
        ours = timed_in(spark, name, folder)
        if not QUERIES[name].sql:
            print(f"| {name} | {ours:.2f} | no SQL | - |", flush=True)
            continue
        start = time.perf_counter()
        con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {registry.oracle(QUERIES[name].columns, QUERIES[name].sql)}")
        check = time.perf_counter() - start
        print(f"| {name} | {ours:.2f} | {check:.2f} | {ours / max(check, 0.01):.1f} |", flush=True)
    spark.stop()
