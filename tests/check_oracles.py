"""Compare registered queries with their SQL: python tests/check_oracles.py [sf] [name …]."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def database(folder: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return names, sorted(plain, key=repr)


def compare(spark, con, folder: str, name: str, query, sql: str | None):
    """(seconds, rows, problem or None)."""
    begun = time.time()
    frame = query(spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    seconds = time.time() - begun
    if sql is None:
        return seconds, len(got[1]), None
    cursor = con.execute(sql)
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return seconds, len(got[1]), f"columns {got[0]} <> {want[0]}"
    if len(got[1]) != len(want[1]):
        return seconds, len(got[1]), f"{len(got[1])} rows <> {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if wrong:
        return seconds, len(got[1]), f"{len(wrong)} rows differ, first {wrong[0]}"
    return seconds, len(got[1]), None


def main() -> None:
    import __spark_entry__ as entry
    from crowdtide.scratch import clear
    from crowdtide.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", 8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    sqls = entry.oracle_sql()
    failed = []
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            seconds, rows, problem = compare(spark, con, folder, name, query, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            seconds, rows, problem = 0.0, 0, f"{type(error).__name__}: {str(error)[:1500]}"
        state = problem or ("ok" if name in sqls else "rows only")
        print(f"{name:32s} {seconds:6.2f}s {rows:8d}  {state[:1700]}", flush=True)
        if problem:
            failed.append(name)
    clear(spark)
    print("FAILED", failed)


if __name__ == "__main__":
    main()
