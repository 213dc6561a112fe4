"""Side-by-side comparison of registered queries with their check SQL.

``python tests/compare.py FOLDER [NAME_OR_PREFIX ...]`` prints one line per query.
"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    text = frame.apply(lambda col: col.map(lambda v: "~" if v is None or v is pd.NA or v != v else repr(
        float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v)))
    return sorted(map(tuple, text.itertuples(index=False)))


def differences(spark_frame, check_frame):
    if sorted(spark_frame.columns) != sorted(check_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(check_frame.columns)}"
    a, b = rows_of(spark_frame), rows_of(check_frame)
    if a == b:
        return None
    in_a, in_b = set(a), set(b)
    only_a = [r for r in a if r not in in_b][:3]
    only_b = [r for r in b if r not in in_a][:3]
    return f"{len(a)} rows against {len(b)}; columns {sorted(spark_frame.columns)}\n    ours  {only_a}\n    check {only_b}"


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    import numpy as np
    return frame.astype(object).map(lambda v: v.item() if isinstance(v, np.generic) else v)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from granary.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8, 8), duck(folder)
    sql, bad = oracle_sql(), []
    for name, build in queries().items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            ours = build(spark, folder).toPandas()
        except Exception as e:
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
            bad.append(name)
            continue
        t1 = time.time()
        if name not in sql:
            print(f"rows {name} {len(ours)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            check = con.execute(sql[name]).fetchdf()
        except Exception as e:
            print(f"SQL  {name}: {str(e)[:1500]}", flush=True)
            bad.append(name)
            continue
        diff = differences(plain(ours), plain(check))
        print(f"{'DIFF' if diff else 'ok  '} {name} {len(ours)} rows {t1 - t0:.1f}s / {time.time() - t1:.1f}s"
              + (f"\n    {diff}" if diff else ""), flush=True)
        bad += [name] if diff else []
    print("not equal:", bad)
