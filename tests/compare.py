"""Runs a query and its oracle SQL side by side and compares the rows exactly."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(frame, con, sql: str) -> str:
    """'' when equal, else what differs."""
    s_names, s_rows = rows_of(frame.columns, frame.collect())
    cur = con.execute(sql)
    d_names, d_rows = rows_of([c[0] for c in cur.description], cur.fetchall())
    if s_names != d_names:
        return f"columns {s_names} != {d_names}"
    if s_rows == d_rows:
        return "" if s_rows else "EMPTY on both sides"
    only_s, only_d = s_rows - d_rows, d_rows - s_rows
    return (
        f"{sum(s_rows.values())} rows vs {sum(d_rows.values())}; {sum(only_s.values())} / {sum(only_d.values())} unmatched; "
        f"e.g. {sorted(only_s, key=str)[:2]} vs {sorted(only_d, key=str)[:2]}"
    )


def main() -> None:
    import __spark_entry__ as entry
    from equispark.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    con = duck(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            problem = compare(frame, con, sql[name]) if name in sql else f"(no oracle) {frame.count()} rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        spent = time.time() - start
        flag = "ok " if not problem else ("-- " if problem.startswith("(no oracle)") else "BAD")
        bad += flag == "BAD"
        if flag != "ok " or wanted or spent > 3:
            print(f"{flag} {name} {spent:.2f}s {problem}", flush=True)
    print(f"{bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
