"""Run queries next to their SQL: ``python -m tests.oracle [folder] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

import __spark_entry__ as contract


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> str:
    """An empty string when both sides agree, else what differs."""
    df = contract.queries()[name](spark, folder)
    ours = [tuple(r) for r in df.collect()]
    cursor = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    if not a:
        return "no rows"
    if a == b:
        return ""
    first = next(((x, y) for x, y in zip(a, b) if x != y), (None, None))
    return f"{len(a)} and {len(b)} rows, first difference {first}"


def main():
    from textloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(contract.queries())
    spark, con = local_session(), connect(folder)
    for name in names:
        start = time.time()
        try:
            if name in contract.oracle_sql():
                verdict = compare(spark, con, folder, name) or "ok"
            else:
                verdict = f"rows {len(contract.queries()[name](spark, folder).collect())}"
        except Exception as error:
            verdict = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {verdict[:1800]}", flush=True)


if __name__ == "__main__":
    main()
