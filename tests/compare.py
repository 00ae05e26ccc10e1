"""Run registered queries against their DuckDB oracle: python tests/compare.py SF_DIR [name ...]"""
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v + 0.0:.6f}" if v else "0.000000"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(key(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, sf_dir, name, fn, sql):
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return (len(got) > 0), f"{len(got)} rows, no oracle", took
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    a, ca = rows_of(df.columns, got)
    b, cb = rows_of(cols, cur.fetchall())
    if ca != cb:
        return False, f"columns {ca} / {cb}", took
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"{len(a)} / {len(b)} rows, first differences {diff}", took
    return True, f"{len(a)} rows", took


def main(sf_dir, names):
    import __spark_entry__ as entry
    from votelens.session import local_session
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or q:
        try:
            ok, text, took = compare(spark, con, sf_dir, name, q[name], o.get(name))
        except Exception as e:  # report and go on with the other queries
            ok, text, took = False, f"{type(e).__name__}: {str(e)[:1500]}", 0
        bad += not ok
        if not ok or took > 3 or names:
            print(f"{'ok ' if ok else 'BAD'} {name:28s} {took:6.2f}s {text}", flush=True)
    print(f"{len(names or q)} queries, {len(o)} oracles, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
