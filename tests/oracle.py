"""Compare every named query with DuckDB on the same files: `python tests/oracle.py [sf] [prefix ...]`."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    return v


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def run_oracle(con, sql):
    con.execute(sql)
    columns = [d[0] for d in con.description]
    return columns, con.fetchall()


def compare(spark, con, sf_dir, build, sql):
    """None when equal, else a short description of the difference."""
    df = build(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    columns, expected = run_oracle(con, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    got, want = multiset(df.columns, rows), multiset(columns, expected)
    if got != want:
        return (
            f"rows {len(rows)} / {len(expected)}; only here {list((got - want).items())[:3]}; "
            f"only there {list((want - got).items())[:3]}"
        )
    return None if rows else "equal but empty"


if __name__ == "__main__":
    import __spark_entry__ as E
    from tallywing.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad, total = duck(sf_dir), E.oracle_sql(), 0, 0
    for name, build in E.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        total += 1
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, build, sqls.get(name))
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        tag = "ok " if problem is None else "BAD"
        bad += problem is not None
        print(f"{tag} {name:34s} {time.time() - start:6.2f}s {'' if name in sqls else '(rows only) '}{problem or ''}", flush=True)
    print(f"{total - bad} of {total} good")
