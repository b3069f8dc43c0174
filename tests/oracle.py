"""Runs registered queries beside their SQL and compares row multisets: python tests/oracle.py SF_DIR [NAME...]"""

import datetime
import decimal
import math
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v else "0"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(decimal.Decimal(repr(round(v, 9))).normalize(), "f") if v else "0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "null" if v is None else str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())


def duck_rows(sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        path = os.path.join(sf_dir, f)
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def main(sf_dir, *names):
    import time

    import __spark_entry__ as entry
    from probatum.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or [n for n in queries if n in oracles]:
        t = time.time()
        try:
            got = spark_rows(queries[name](spark, sf_dir))
            took = time.time() - t
            want = duck_rows(oracles[name], sf_dir) if name in oracles else got
            same = got == want
            print(f"{'ok  ' if same else 'DIFF'} {name} rows={len(got[1])} {took:.1f}s" + ("" if name in oracles else " (no SQL)"), flush=True)
            if not same:
                bad += 1
                print("   columns", got[0], want[0], "rows", len(got[1]), len(want[1]))
                a, b = set(got[1]), set(want[1])
                print("   only spark", sorted(a - b)[:4])
                print("   only sql  ", sorted(b - a)[:4])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {str(e)[:700]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
