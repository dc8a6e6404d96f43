"""Run registered queries next to their SQL and compare rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of_sql(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    return names, types, cur.fetchall()


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def difference(spark_df, con, sql: str, show: int = 3) -> str | None:
    """None if equal, else a short description."""
    names, types, want = rows_of_sql(con, sql)
    got = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    have = dict(spark_df.dtypes)
    off = [(n, have[n], t) for n, t in zip(names, types) if kinds.get(have[n], have[n]) != t]
    if off:
        return f"types differ: {off}"
    order = sorted(names)
    a = sorted((tuple(_plain(r[spark_df.columns.index(n)]) for n in order) for r in got), key=repr)
    b = sorted((tuple(_plain(r[names.index(n)]) for n in order) for r in want), key=repr)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; e.g. {order} {a[:show]} / {b[:show]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, {order}: " + "; ".join(f"{x} != {y}" for x, y in bad[:show])
    return None


def main(argv):
    from tidecast.session import local_session
    import __spark_entry__ as entry
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session(cores=8)
    con = connect(folder)
    oracles = entry.oracle_sql()
    failures = []
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                df = fn(spark, folder)
                problem = difference(df, con, oracles[name])
                n = ""
            else:
                n = len(fn(spark, folder).collect())
                problem = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        kind = "sql " if name in oracles else f"rows {n}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s", flush=True)
        if problem:
            print("     ", problem[:2500], flush=True)
            failures.append(name)
    print(f"{len(failures)} failures: {failures}")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
