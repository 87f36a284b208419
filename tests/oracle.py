"""Run registered queries next to their DuckDB text and compare every value.

    python -m tests.oracle [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPARK_TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "smallint": "SMALLINT", "float": "FLOAT", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def _same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def compare(df, con, sql: str) -> tuple[int, str | None]:
    """Row count, and the first difference or None."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = dict(zip(names, [str(d[1]) for d in rel.description]))
    want = rel.fetchall()
    cols = sorted(df.columns)
    if cols != sorted(names):
        return 0, f"columns {cols} vs {sorted(names)}"
    spark_types = dict(df.dtypes)
    for c in cols:
        have = SPARK_TYPES.get(spark_types[c], spark_types[c])
        if have != types[c].upper():
            return 0, f"type of {c}: {spark_types[c]} vs {types[c]}"
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    order = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in order) for r in want]
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}"
    got.sort(key=_key)
    want.sort(key=_key)
    bad = [(g, w) for g, w in zip(got, want) if not all(_same(a, b) for a, b in zip(g, w))]
    if bad:
        return len(got), f"{len(bad)} rows differ, columns {cols}: {bad[0]}"
    return len(got), None


def main() -> int:
    import __spark_entry__ as entry
    from forgeclock.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--plain", action="store_true", help="use Spark's default settings")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    if args.plain:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(8)
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if args.names and not any(name == n or name.startswith(n) for n in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                rows, diff = compare(df, con, oracles[name])
            else:
                rows, diff = len(df.collect()), None
        except Exception as exc:  # report and go on
            rows, diff = 0, f"{type(exc).__name__}: {str(exc)[:900]}"
        note = "" if name in oracles else " (no oracle)"
        print(f"{'FAIL' if diff else 'ok  '} {name:38s} rows={rows:7d} {time.time() - t0:6.2f}s{note} {diff or ''}", flush=True)
        if diff:
            failed.append(name)
        elif rows == 0:
            print(f"     {name}: EMPTY RESULT")
    print(f"failed: {failed}" if failed else "all equal")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
