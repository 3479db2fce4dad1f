"""Run registered queries in Spark and their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

from wardline.plans.registry import TABLES, Tables, load_all


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) else round(value, 9)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, folder: str, name: str) -> str | None:
    """None when both agree, else what differs."""
    q = load_all()[name]
    df = q.run(Tables(spark, folder))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if q.sql is None:
        return None if got else "no rows"
    cur = con.execute(q.sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if not want:
        return "the SQL returns no rows"
    if got != want:
        only_a = [r for r in got if r not in set(want)][:3] if len(got) < 200000 else []
        only_b = [r for r in want if r not in set(got)][:3] if len(got) < 200000 else []
        return f"{len(got)} vs {len(want)} rows; spark only {str(only_a)[:600]}; sql only {str(only_b)[:600]}"
    return None


def main() -> None:
    from wardline.session import build_session

    folder = sys.argv[1]
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted = sys.argv[2:] or list(load_all())
    names = [n for n in load_all() if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'OK  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
