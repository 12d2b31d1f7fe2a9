"""Run registered queries and their SQL side by side and compare rows and column types."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
}


def open_oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def check(spark, con, sf_dir: str, name: str) -> tuple[str | None, int]:
    """(what differs or None, row count)."""
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(got)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = dict(zip(names, [str(d[1]) for d in cur.description]))
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}", len(got)
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    bad = [
        f"{c}: {t} != {types[c]}" for c, t in df.select(*cols).dtypes if TYPES.get(t, t) != types[c]
    ]
    if bad:
        return "types " + ", ".join(bad), len(got)
    if Counter(got) != Counter(want):
        more, less = Counter(got) - Counter(want), Counter(want) - Counter(got)
        return (
            f"rows {len(got)} != {len(want)}; only here {list(more)[:2]}; only there {list(less)[:2]}",
            len(got),
        )
    return None, len(got)


if __name__ == "__main__":
    from feedloom.session import build_session

    sf = sys.argv[1]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = open_oracle(sf)
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            problem, n = check(spark, con, sf, name)
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={n} {time.time() - start:.1f}s {(problem or '')[:1500]}", flush=True)
