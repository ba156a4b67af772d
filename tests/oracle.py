"""Compare registered queries with their SQL counterparts.

    python tests/oracle.py [folder] [name ...]

NO_COALESCE=1 keeps every shuffle partition, so that ordered operators work over many stretches.
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.9g}")
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, int):
        return value
    if hasattr(value, "as_tuple"):
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (int, float)) else (v is None, "n", v) for v in r))


def compare(spark, con, folder: str, name: str, queries, oracles) -> str | None:
    """None when equal, else a description of the first difference."""
    df = queries[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    if name not in oracles:
        return None if got else "no rows"
    cur = con.execute(oracles[name])
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if not want:
        return f"{len(got)} rows, the SQL none" if got else "the SQL gives no rows"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    kinds = {}
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(columns)}: {x} != {y}"
        for i, (p, q) in enumerate(zip(x, y)):
            if p is not None and type(p) is not type(q):
                kinds[sorted(columns)[i]] = (type(p).__name__, type(q).__name__)
    return f"types {kinds}" if kinds else None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tillmark.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    q, o = queries(), oracle_sql()
    names = argv[1:] or list(q)
    keep = "false" if os.environ.get("NO_COALESCE") else "true"
    spark = build_session(master="local[8]", **{"spark.sql.adaptive.coalescePartitions.enabled": keep, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for n in names:
        t = time.time()
        try:
            problem = compare(spark, con, folder, n, q, o)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {n} {time.time() - t:.1f}s {'' if n in o else '(rows only) '}{problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
