"""Run registered queries against their SQL twins and report every difference.

    python tests/compare.py [sf_dir] [name ...]

MAX_GROUP_ROWS=20 in the environment makes every larger group count as hot, so that the
splitting plans are compared too.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if type(value).__name__ == "Decimal":
        return plain(float(value))
    return value


def sort_key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float")), v if isinstance(v, (int, float)) else str(v)) for v in row)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def differences(left, right, exact=True):
    bad = []
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            if x == y:
                continue
            if not exact and isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9):
                continue
            bad.append((a, b))
            break
    return bad


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def main(argv):
    import __spark_entry__ as entry
    from rosterlake.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="10g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("MAX_GROUP_ROWS"):
        spark.conf.set("spark.rosterlake.maxGroupRows", os.environ["MAX_GROUP_ROWS"])
    con = duck(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name:28s} {len(rows):7d} rows {took:5.1f}s", flush=True)
                continue
            cur = con.execute(sql[name])
            cols = [d[0] for d in cur.description]
            expected = cur.fetchall()
            if sorted(cols) != sorted(df.columns):
                raise AssertionError(f"columns {sorted(df.columns)} vs {sorted(cols)}")
            if len(rows) != len(expected):
                raise AssertionError(f"rows {len(rows)} vs {len(expected)}")
            bad = differences(canonical(rows, df.columns), canonical(expected, cols))
            if bad:
                raise AssertionError(f"{len(bad)} of {len(rows)} rows differ, e.g. {sorted(cols)}: {bad[0]}")
            empty = "  EMPTY" if not rows else ""
            print(f"ok    {name:28s} {len(rows):7d} rows {took:5.1f}s{empty}", flush=True)
        except Exception as e:  # noqa: BLE001
            failed.append(name)
            print(f"FAIL  {name:28s} {str(e)[:700]}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
