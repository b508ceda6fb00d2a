"""Spark-vs-DuckDB comparison used by the tests (and runnable by hand).

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


EXACT = False  # set by --exact: compare doubles bit for bit


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, (int, float)):
        f = float(v)
        if math.isnan(f):
            return (2, "nan")
        if EXACT:
            return (1, f)
        return (1, round(f, 9) if abs(f) < 1e6 else float(f"{f:.12g}"))
    if isinstance(v, (list, tuple)):
        return (3, tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return (4, tuple(sorted((k, _norm(x)) for k, x in v.items())))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return (5, str(v))


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
                 "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}


def compare(spark, sf_dir: str, name: str, query, sql: str, con=None):
    """Returns (ok, message). Column names and types must agree; rows are compared as sorted
    multisets with columns sorted by name."""
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r[c] for c in sorted(s_cols)) for r in sdf.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_raw = rel.fetchall()
    idx = {c: i for i, c in enumerate(d_cols)}
    if sorted(s_cols) != sorted(d_cols):
        return False, f"{name}: columns differ spark={sorted(s_cols)} duck={sorted(d_cols)}"
    d_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    bad_types = [(f.name, f.dataType.simpleString(), d_types[f.name]) for f in sdf.schema.fields
                 if SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) != d_types[f.name]]
    if bad_types:
        return False, f"{name}: types differ {bad_types}"
    d_rows = [tuple(r[idx[c]] for c in sorted(d_cols)) for r in d_raw]
    a = sorted(tuple(_norm(v) for v in r) for r in s_rows)
    b = sorted(tuple(_norm(v) for v in r) for r in d_rows)
    if len(a) != len(b):
        return False, f"{name}: rows spark={len(a)} duck={len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return False, f"{name}: first diff spark={x} duck={y}"
    return True, f"{name}: ok rows={len(a)} spark={t1 - t0:.2f}s"


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from sightings.session import build_session

    global EXACT
    if argv and argv[0] == "--exact":
        EXACT, argv = True, argv[1:]
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(E.oracle_sql())
    spark = build_session("local[8]")
    con = duck(sf_dir)
    qs, oracles = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, sf_dir, n, qs[n], oracles[n], con)
        except Exception as e:  # report and continue
            ok, msg = False, f"{n}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(("OK  " if ok else "BAD ") + msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
