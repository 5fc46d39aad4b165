"""Run registered queries against their SQL on DuckDB and report differences.

usage: python tools/check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from marketloom.plans import catalog  # noqa: E402
from marketloom.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(path: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v == v else 0) if not isinstance(v, float) else (v is None, "f", round(v, 4) if v == v else 0) for v in row)


def compare(spark_rows: list[tuple], sql_rows: list[tuple], columns: list[str]) -> list[str]:
    problems = []
    if len(spark_rows) != len(sql_rows):
        problems.append(f"rows {len(spark_rows)} != {len(sql_rows)}")
    bad: dict[str, list] = {}
    for a, b in zip(sorted(spark_rows, key=_key), sorted(sql_rows, key=_key)):
        for name, x, y in zip(columns, a, b):
            if x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)):
                continue
            bad.setdefault(name, []).append((x, y))
    for name, pairs in bad.items():
        problems.append(f"{name}: {len(pairs)} differ, e.g. {pairs[:3]}")
    return problems


def check(spark, con, name: str, path: str) -> tuple[list[str], int]:
    out = catalog.QUERIES[name](spark, path)
    columns = sorted(out.columns)
    rows = [tuple(r) for r in out.select(*columns).collect()]
    if name not in catalog.ORACLES:
        return ([] if rows else ["no rows"]), len(rows)
    rel = con.execute("SELECT " + ", ".join(columns) + f" FROM ({catalog.ORACLES[name]})")
    sql_rows = [tuple(r) for r in rel.fetchall()]
    return compare(rows, sql_rows, columns), len(rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    path = f"/root/testdata/sf{args.sf}"
    spark, con = build_session("local[8]"), connect(path)
    failed = 0
    chosen = [n for n in catalog.QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    for name in chosen:
        start = time.time()
        try:
            problems, n = check(spark, con, name, path)
        except Exception as exc:  # noqa: BLE001 - the report goes on
            problems, n = [f"{type(exc).__name__}: {str(exc)[:1500]}"], -1
        mark = "ok " if not problems else "BAD"
        failed += bool(problems)
        kind = "" if name in catalog.ORACLES else " (rows only)"
        print(f"{mark} {name} rows={n} {time.time() - start:.2f}s{kind}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print(f"{len(chosen) - failed}/{len(chosen)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
