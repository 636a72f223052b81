"""Compare queries with their SQL twins: python tests/oracle.py [SF_DIR] [NAME...]"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, (list, tuple)):
            return tuple(value(x) for x in v)
        if isinstance(v, float):
            return repr(v)
        return str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"rows {len(got)} (no SQL) {t1 - t0:.1f}s", True
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    t2 = time.time()
    a, b = canon(got, df.columns), canon(want, names)
    ok = sorted(df.columns) == sorted(names) and a == b
    note = f"{'ok' if ok else 'MISMATCH'} rows {len(got)} vs {len(want)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if not ok:
        note += f" columns {df.columns} vs {names}; only spark {[x for x in a if x not in set(b)][:3]}; only sql {[x for x in b if x not in set(a)][:3]}"
    return note, ok


if __name__ == "__main__":
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    sf = next((x for x in sys.argv[1:] if "/" in x), "/root/testdata/sf0.01")
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf), e.oracle_sql(), []
    names = [x for x in sys.argv[1:] if "/" not in x]
    for name, fn in e.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            note, ok = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as x:
            note, ok = f"ERROR {str(x)[:1500]}", False
        print(name, note, flush=True)
        bad += [] if ok else [name]
    print("BAD", bad)
