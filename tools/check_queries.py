"""Compare registered queries with their SQL twins in DuckDB.

    python tools/check_queries.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import collections
import os
import pathlib
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from queuetide.session import build_session  # noqa: E402

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE"}


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--plain", action="store_true", help="a session with Spark's own defaults")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    from queuetide.registry import QUERIES, SQL

    con = duckdb.connect()
    for f in pathlib.Path(args.sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    from pyspark.sql import SparkSession

    if args.plain:
        spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false").getOrCreate()
    else:
        spark = build_session(master=os.environ.get("MASTER", "local[8]"), **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                    "spark.driver.memory": "8g",
                                                    "spark.ui.showConsoleProgress": "false",
                                                    "spark.checkpoint.dir": tempfile.mkdtemp(prefix="queuetide-")})
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    names = [n for n in QUERIES if not args.names or any(a in n for a in args.names)]
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - t0
            if name not in SQL:
                print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
                continue
            cur = con.execute(SQL[name])
            cols, kinds = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
            want = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:700]}", flush=True)
            continue
        notes = []
        order = sorted(cols)
        if order != sorted(df.columns):
            notes.append(f"columns {sorted(df.columns)} vs {order}")
        else:
            mine = dict(df.dtypes)
            for c, k in zip(cols, kinds):
                if TYPES.get(mine[c], mine[c]) != k:
                    notes.append(f"type of {c}: {mine[c]} vs {k}")
            a = collections.Counter(tuple(r[df.columns.index(c)] for c in order) for r in got)
            b = collections.Counter(tuple(r[cols.index(c)] for c in order) for r in want)
            if a != b:
                notes.append(f"values differ {order}: only here {list((a - b).items())[:4]} only sql {list((b - a).items())[:4]}"
                             f" counts {sum((a - b).values())}/{sum((b - a).values())}")
        if len(got) != len(want):
            notes.append(f"rows {len(got)} vs {len(want)}")
        bad += bool(notes)
        print(f"{'BAD  ' if notes else 'ok   '} {name}: {len(got)} rows {took:.1f}s {'; '.join(notes)}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
