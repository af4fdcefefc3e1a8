"""Runs queries against their SQL twins: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import logging
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def ordered(names, rows):
    places = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in places) for r in rows]
    return [names[i] for i in places], sorted(out, key=repr)


def differences(df, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a short description."""
    return compared(df.columns, [tuple(r) for r in df.collect()], sql, sf_dir)


def compared(columns, rows, sql: str, sf_dir: str) -> str | None:
    ours = ordered(columns, rows)
    theirs = ordered(*oracle_rows(sql, sf_dir))
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        only = set(map(repr, ours[1])) ^ set(map(repr, theirs[1]))
        return f"rows {len(ours[1])} != {len(theirs[1])}: {sorted(only)[:4]}"
    for a, b in zip(ours[1], theirs[1], strict=True):
        if a != b:
            return f"{ours[0]}\n  spark {a}\n  sql   {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from bench import session
    from guardmill.operators.scratch import owned_scratch

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(entry.queries())
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    spark = session()
    oracles, bad = entry.oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            with owned_scratch(spark):
                df = entry.queries()[name](spark, sf_dir)
                rows = [tuple(r) for r in df.collect()]
            middle = time.time()
            if name in oracles:
                problem = compared(df.columns, rows, oracles[name], sf_dir)
                state = "ok" if problem is None else f"DIFFERENT {problem}"
            else:
                problem, state = None, "rows only"
        except Exception as error:  # report and go on with the next query
            rows, middle = [], time.time()
            problem = state = f"ERROR {str(error)[:900]}"
        bad += problem is not None
        print(f"\n@ {name:24s} {middle - start:6.1f}s {time.time() - middle:6.1f}s "
              f"{len(rows):8d}  {state}", flush=True)
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
