"""Compare registered queries with their DuckDB oracles.

Usage: python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from keelson.registry import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value) -> str:
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if value != value:
            return "nan"
        return repr(0.0 if value == 0 else value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def shape(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(canonical(row[i]) for i in order) for row in rows)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return [columns[i] for i in order], lines, digest


def compare(spark, build, sql, sf_dir, con):
    started = time.time()
    frame = build(spark, sf_dir)
    columns, rows = frame.columns, [tuple(r) for r in frame.collect()]
    spent = time.time() - started
    got = shape(columns, rows)
    if sql is None:
        return ("ROWS" if rows else "EMPTY"), len(rows), spent, 0.0, ""
    started = time.time()
    cursor = con.execute(sql)
    want = shape([d[0] for d in cursor.description], cursor.fetchall())
    duck = time.time() - started
    if got[0] != want[0]:
        return "COLS", len(rows), spent, duck, f"{got[0]} vs {want[0]}"
    if got[2] != want[2]:
        left, right = set(got[1]), set(want[1])
        extra = sorted(left - right)[:3]
        missing = sorted(right - left)[:3]
        note = f"rows {len(got[1])} vs {len(want[1])}; spark-only {len(left - right)} {extra}; sql-only {len(right - left)} {missing}"
        return "DIFF", len(rows), spent, duck, note[:1500]
    return ("OK" if rows else "OK-EMPTY"), len(rows), spent, duck, ""


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        del argv[at : at + 2]
    import __spark_entry__ as entry
    from keelson.session import build_session

    spark = build_session("oracle", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            status, rows, spent, duck, note = compare(spark, build, sqls.get(name), sf_dir, con)
        except Exception as error:  # report and go on
            status, rows, spent, duck, note = "FAIL", 0, 0.0, 0.0, str(error)[:1200]
        if status in ("COLS", "DIFF", "FAIL", "EMPTY"):
            bad += 1
        print(f"{status:9s} {name:34s} rows={rows:<7d} spark={spent:6.2f}s duck={duck:6.2f}s {note}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
