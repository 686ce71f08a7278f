"""Run registered queries against their SQL in DuckDB and report every difference.

    python tools/verify.py [--sf DIR] [names or prefixes..]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from radiolens.catalog import CHECKS, Tables  # noqa: E402
from radiolens.catalog.base import TABLES  # noqa: E402
from radiolens.plans.stage import release  # noqa: E402
from radiolens.session import local_session  # noqa: E402


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(repr(plain(v)) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}={plain(v)!r}" for k, v in value.items()) + "}"
    if isinstance(value, (str, int)):
        return value
    if isinstance(value, float):
        return value + 0.0  # -0.0 counts as 0.0
    return f"{type(value).__name__}:{value}"


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{args.sf}/{t}.parquet'")
    spark = local_session(8)
    bad = 0
    for name, check in CHECKS.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        began = time.time()
        try:
            frame = check.run(Tables(spark, args.sf))
            rows = [tuple(r.asDict(recursive=True)[c] for c in frame.columns) for r in frame.collect()]
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
            continue
        spent = time.time() - began
        release(spark)
        if not check.sql:
            print(f"rows  {name}: {len(rows)} rows {spent:.1f}s", flush=True)
            continue
        began = time.time()
        try:
            result = con.execute(check.sql)
            names = [d[0] for d in result.description]
            want = result.fetchall()
        except Exception as error:
            bad += 1
            print(f"FAIL  {name}: SQL {str(error)[:600]}", flush=True)
            continue
        took = time.time() - began
        if sorted(names) != sorted(frame.columns):
            bad += 1
            print(f"FAIL  {name}: columns {sorted(frame.columns)} / {sorted(names)}", flush=True)
            continue
        got, want = normal(rows, frame.columns), normal(want, names)
        if list(map(repr, got)) == list(map(repr, want)):
            note = "  EMPTY" if not got else ""
            print(f"ok    {name}: {len(got)} rows {spent:.1f}s (sql {took:.1f}s){note}", flush=True)
            continue
        bad += 1
        diff = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)][:2]
        print(f"FAIL  {name}: {len(got)}/{len(want)} rows {sorted(names)} {diff}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
