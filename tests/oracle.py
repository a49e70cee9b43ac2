"""Compare registered queries with their SQL on the driver's tables.

Run as a script: python tests/oracle.py <sf_dir> [name part ...]
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


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, (int, float)):
        return (1, round(float(v), 3))
    return (2, str(v))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in order) for r in rows]
    # Whole-number and text columns first: rounding noise must not reorder rows.
    return sorted(columns), sorted(out, key=lambda r: [_key(v) for v in r if not isinstance(v, float)]
                                   + [_key(v) for v in r if isinstance(v, float)])


def compare(spark_df, con, sql, tolerance=1.5e-6):
    """(row count, number of rows whose values differ exactly, first true difference)."""
    got_cols, got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = _rows([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return len(got), 0, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return len(got), 0, f"rows {len(got)} != {len(want)}"
    inexact = 0
    for g, w in zip(got, want):
        if g == w:
            continue
        same = True
        for a, b in zip(g, w):
            if isinstance(a, float) and isinstance(b, float):
                if math.isnan(a) and math.isnan(b):
                    continue
                same &= abs(a - b) <= tolerance * max(1.0, abs(b))
            else:
                same &= type(a) is type(b) and a == b
        if not same:
            return len(got), inexact, f"{dict(zip(got_cols, g))} != {dict(zip(got_cols, w))}"
        inexact += 1
    return len(got), inexact, None


def main() -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from cellcast import build_session

    spark = build_session(
        master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                rows, inexact, error = compare(df, con, oracles[name])
            else:
                rows, inexact, error = df.count(), 0, None
        except Exception as exc:  # noqa: BLE001
            rows, inexact, error = -1, 0, f"{type(exc).__name__}: {str(exc)[:600]}"
        mark = "FAIL" if error else ("oracle" if name in oracles else "rows")
        bad += bool(error)
        note = f" inexact={inexact}" if inexact else ""
        empty = " EMPTY" if rows == 0 else ""
        print(f"{mark:6} {name:32} rows={rows:<8} {time.time() - started:5.1f}s{note}{empty} {error or ''}", flush=True)
    print(f"{len(queries)} queries, {len(oracles)} oracles, {bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(main())
