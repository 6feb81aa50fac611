"""Run registered queries on Spark and DuckDB and compare them as multisets.

    python tests/check_oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import __spark_entry__ as entry  # noqa: E402
from hybridq.session import local_session  # noqa: E402
from hybridq.workload.tables import BASE  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir, verbose=True):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return None, f"rows-only {len(got)} rows, spark {t1 - t0:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    info = f"{len(got)} rows, spark {t1 - t0:.1f}s, duck {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, info
    text = [f"{info}; duck {len(b)} rows"]
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    text.append(f"columns {sorted(df.columns)}; differing {len(only_a)} / {len(only_b)}")
    if verbose:
        text += [f"  spark {str(r)[:700]}" for r in only_a[:3]] + [f"  duck  {str(r)[:700]}" for r in only_b[:3]]
    return False, "\n".join(text)


def main():
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        try:
            ok, info = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, info = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += ok is False
        print(("OK   " if ok else "ROWS " if ok is None else "FAIL ") + name, info, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
