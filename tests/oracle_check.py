"""Compare registered queries with their SQL on one scale: ``python tests/oracle_check.py [dir] [names…]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_normal(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql) -> str | None:
    """None when equal, otherwise what differs."""
    frame = query(spark, sf_dir)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if ours[1] != theirs[1]:
        in_ours, in_theirs = set(ours[1]), set(theirs[1])
        left = [r for r in ours[1] if r not in in_theirs][:3]
        right = [r for r in theirs[1] if r not in in_ours][:3]
        return f"{len(ours[1])} / {len(theirs[1])} rows; only ours {left}; only SQL {right}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from ledgerloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con, sql = local_session(8), connect(sf_dir), entry.oracle_sql()
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        start = time.time()
        try:
            wrong = compare(spark, con, sf_dir, entry.queries()[name], sql[name])
        except Exception as error:  # keep checking the others
            wrong = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if wrong is None else 'FAIL'} {name} {time.time() - start:.1f}s {wrong or ''}",
              flush=True)


if __name__ == "__main__":
    main()
