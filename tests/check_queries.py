"""Run registered queries beside their SQL in DuckDB and compare the rows.

usage: python tests/check_queries.py [--sf 0.01] [--dir folder] [--hot-rows n] [name-prefix ...]

``--hot-rows`` lowers the size from which a key counts as hot, so that the
skew-safe plans run on small data; ``--dir`` takes e.g. a skewed copy of the tables.
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{v:.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in idx) for r in rows)


def compare(spark, con, sf_dir, name, queries, oracles):
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if name not in oracles:
        return ("rows-only" if got else "EMPTY"), len(got), took, ""
    cur = con.execute(oracles[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        kinds = dict(df.dtypes)
        duck = {d[0]: str(d[1]) for d in cur.description}
        odd = [f"{c}:{kinds[c]}/{duck[c]}" for c in cols if not same_type(kinds[c], duck[c])]
        return ("ok" if got else "EMPTY"), len(got), took, " ".join(odd)
    extra = [x for x in a if x not in set(b)][:3]
    missing = [x for x in b if x not in set(a)][:3]
    return "DIFF", len(got), took, f"rows {len(a)} vs {len(b)}\n   spark {extra}\n   sql   {missing}"


PAIRS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "date": "DATE"}


def same_type(spark_type, duck_type):
    if spark_type.startswith("array"):
        return duck_type.endswith("[]")
    return PAIRS.get(spark_type) == duck_type or (spark_type == "timestamp" and duck_type.startswith("TIMESTAMP"))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--dir")
    ap.add_argument("--hot-rows", type=int)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from vulnlake import build_session

    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = args.dir or f"/root/testdata/sf{args.sf}"
    if args.hot_rows:
        from vulnlake.operators import ordered

        ordered.HOT_KEY_ROWS = args.hot_rows
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n.startswith(p) for p in args.names)]
    bad = 0
    for n in names:
        try:
            status, count, took, note = compare(spark, con, sf_dir, n, queries, oracles)
        except Exception as e:  # report and go on with the next query
            status, count, took, note = "ERROR", 0, 0.0, str(e)[:700]
        bad += status not in ("ok", "rows-only")
        print(f"{status:9} {count:8} {took:6.2f}s {n} {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good; {sum(n in oracles for n in names)} with SQL")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
