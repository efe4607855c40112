"""Compare registered queries with their check SQL: ``python tests/check.py [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
import pandas as pd

from annotlake.fixtures import SOURCES

KINDS = {"i": "int", "u": "int", "f": "float", "b": "bool"}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute("set memory_limit='8GB'")
    con.execute("set max_temp_directory_size='0GB'")
    for name in SOURCES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or v is pd.NaT:
            return "\0null"
        if isinstance(v, float):
            return "\0nan" if v != v else f"{v + 0.0:.9g}"
        if isinstance(v, (bytes, bytearray)):
            return v.hex()
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
               "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB", "float": "FLOAT"}


def compare(spark, folder, con, name, fn, sql):
    """None when equal, else a message."""
    df = fn(spark, folder)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    names, types = [d[0] for d in rel.description], [str(d[1]) for d in rel.description]
    want = plain(rel.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}", len(got)
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"rows {len(got)} against {len(want)}; only spark {list(a)[:3]}; only sql {list(b)[:3]}", len(got)
    mine = {c: SPARK_TYPES.get(t, t) for c, t in df.dtypes}
    off = [(n, mine[n], t) for n, t in zip(names, types) if mine[n] != t]
    return (f"types {off}" if off else None), len(got)


def main() -> None:
    import os

    import __spark_entry__ as entry
    from annotlake.session import build_session

    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark, con = build_session(), connect(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[1:] or list(queries)
    bad = 0
    for name in wanted:
        started = time.time()
        try:
            if name in checks:
                message, n = compare(spark, folder, con, name, queries[name], checks[name])
            else:
                n, message = len(queries[name](spark, folder).collect()), None
        except Exception as error:  # noqa: BLE001
            message, n = f"{type(error).__name__}: {str(error)[:700]}", -1
        bad += message is not None
        state = "FAIL " + message if message else ("ok" if name in checks else "ran")
        print(f"{name:32s} {n:8d} {time.time() - started:6.1f}s {state}", flush=True)
    print("bad", bad, "of", len(wanted))


if __name__ == "__main__":
    main()
