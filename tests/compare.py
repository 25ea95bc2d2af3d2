"""Runs a query and its SQL and compares the rows, as the driver does."""

import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    return got, want


def main(names, sf_dir="/root/testdata/sf0.01"):
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = duck(sf_dir), e.queries(), e.oracle_sql()
    for name in names or qs:
        t = time.time()
        try:
            if name not in sqls:
                print(name, "no SQL,", qs[name](spark, sf_dir).count(), "rows", f"{time.time() - t:.1f}s", flush=True)
                continue
            got, want = compare(spark, con, sf_dir, qs[name], sqls[name])
            same = got == want
            print(name, "OK" if same else "DIFF", len(got[1]), len(want[1]), f"{time.time() - t:.1f}s", flush=True)
            if not same:
                bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w][:1]
                print("  ", got[0], want[0], str(bad)[:1500])
        except Exception as err:
            print(name, "ERROR", str(err)[:600], flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
