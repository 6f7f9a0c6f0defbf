"""Runs registered queries on Spark and their SQL on DuckDB and compares all values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        if math.isnan(value):
            return ("float", "nan")
        return ("float", float(f"{value:.9g}") + 0.0)
    if isinstance(value, str):
        return ("str", value)
    return (type(value).__name__, str(value))


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, query, sf_dir):
    started = time.time()
    df = query.build(spark, sf_dir)
    got_cols, got = normalise(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if query.sql is None:
        return ("rows", len(got), spent, "")
    cur = con.execute(query.sql)
    want_cols, want = normalise([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return ("FAIL", len(got), spent, f"columns {got_cols} vs {want_cols}")
    if len(got) != len(want):
        return ("FAIL", len(got), spent, f"rows {len(got)} vs {len(want)}; {got[:2]} vs {want[:2]}")
    for a, b in zip(got, want):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y]
            return ("FAIL", len(got), spent, f"first difference {diff[:4]}")
    return ("ok" if got else "EMPTY", len(got), spent, "")


def main() -> int:
    sys.path.insert(0, ".")
    from __spark_entry__ import catalog
    from traceaudit.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name, query in catalog().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            status, rows, spent, note = compare(spark, con, query, sf_dir)
        except Exception as exc:  # report and go on with the other queries
            status, rows, spent, note = "ERROR", 0, 0.0, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += status not in ("ok", "rows")
        print(f"{status:6} {name:42} rows={rows:<7} {spent:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
