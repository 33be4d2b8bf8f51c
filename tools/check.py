"""Compare registered queries with their SQL oracles on one table set.

usage: python tools/check.py [-d DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from gyre.plans import oracles, queries  # noqa: E402
from gyre.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("-d", default="/root/testdata/sf0.01")
    args.add_argument("prefix", nargs="*")
    opts = args.parse_args()
    con, spark = connect(opts.d), local_session()
    sql, bad = oracles(), 0
    for name, run in queries().items():
        if opts.prefix and not any(name.startswith(p) for p in opts.prefix):
            continue
        began = time.time()
        try:
            frame = run(spark, opts.d)
            cols, mine = frame.columns, [tuple(r) for r in frame.collect()]
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: spark {str(error)[:700]}", flush=True)
            continue
        took = time.time() - began
        if name not in sql:
            print(f"rows {name}: {len(mine)} rows {took:.1f}s", flush=True)
            continue
        try:
            cursor = con.execute(sql[name])
            theirs_cols = [d[0] for d in cursor.description]
            theirs = cursor.fetchall()
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: duckdb {str(error)[:700]}", flush=True)
            continue
        a, b = canonical(cols, mine), canonical(theirs_cols, theirs)
        kinds = [(type(x).__name__, type(y).__name__) for x, y in zip(a[0], b[0]) if x is not None and y is not None] if a and b else []
        if sorted(cols) != sorted(theirs_cols):
            bad += 1
            print(f"FAIL {name}: columns {sorted(cols)} {sorted(theirs_cols)}")
        elif a != b:
            bad += 1
            odd = [(x, y) for x, y in zip(a, b) if x != y][:2]
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows; {sorted(cols)}; first {odd}", flush=True)
        elif any(x != y for x, y in kinds):
            bad += 1
            print(f"FAIL {name}: types {kinds}", flush=True)
        else:
            print(f"ok   {name}: {len(a)} rows {took:.1f}s", flush=True)
    print("failures:", bad)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
