"""Run registered queries against their SQL twins; also a command line tool."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_by_name(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> tuple[list, list, list, list]:
    frame = fn(spark, sf_dir)
    ours = rows_by_name(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_by_name(names, cursor.fetchall())
    return sorted(frame.columns), sorted(names), ours, theirs


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tapeloom.session import local_session

    sf = os.environ.get("SF", "0.01")
    directory = f"/root/testdata/sf{sf}"
    wanted = sys.argv[1:]
    spark = local_session(8)
    con = oracle_connection(directory)
    twins = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        begin = time.time()
        try:
            if name not in twins:
                n = len(fn(spark, directory).collect())
                print(f"rows {name}: {n} ({time.time() - begin:.1f}s)")
                continue
            cols, names, ours, theirs = compare(spark, con, fn, twins[name], directory)
        except Exception as exc:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {type(exc).__name__}: {str(exc)[:1500]}")
            continue
        good = cols == names and ours == theirs
        bad += not good
        print(f"{'ok  ' if good else 'DIFF'} {name}: {len(ours)}/{len(theirs)} rows ({time.time() - begin:.1f}s)")
        if not good:
            print("   columns", cols, names)
            for a, b in [(a, b) for a, b in zip(ours, theirs) if a != b][:3]:
                print("   spark ", str(a)[:600])
                print("   oracle", str(b)[:600])
    print("bad:", bad)
