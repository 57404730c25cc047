"""Runs registered queries next to their oracle SQL and compares values."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def _kind(v):
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(v), type(v).__name__)


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(name: str, df, sql: str, con) -> str | None:
    """None if both sides agree, else a short description."""
    spark_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    duck_rows = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} against {sorted(cols)}"
    if len(spark_rows) != len(duck_rows):
        return f"{name}: {len(spark_rows)} rows against {len(duck_rows)}"
    for c in cols:
        i, j = df.columns.index(c), cols.index(c)
        a = {_kind(r[i]) for r in spark_rows if r[i] is not None}
        b = {_kind(r[j]) for r in duck_rows if r[j] is not None}
        if a != b:
            return f"{name}: column {c} has {a} against {b}"
    a, b = _rows(df.columns, spark_rows), _rows(cols, duck_rows)
    only_a, only_b = Counter(a) - Counter(b), Counter(b) - Counter(a)
    if only_a:
        return (f"{name}: {sum(only_a.values())} of {len(a)} rows differ in {sorted(cols)}, "
                f"as {sorted(only_a)[:2]} against {sorted(only_b)[:2]}")
    return None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from voltatlas.session import local_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session(os.environ.get("CORES", "8"))
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracle:
                problem = compare(name, df, oracle[name], con)
            else:
                problem = None if df.count() >= 0 else "no rows"
        except Exception as e:  # a failing query is a finding, the rest still runs
            problem = f"{name}: {type(e).__name__} {str(e)[:600]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.time() - t:.2f}s {'' if name in oracle else '(no oracle)'}"
              f"{' ' + problem if problem else ''}", flush=True)
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
