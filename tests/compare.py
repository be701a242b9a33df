"""Runs queries beside their oracle SQL in DuckDB and compares the rows as multisets."""

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, name, query, sql, sf_dir):
    """None if both agree, else what differs."""
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.sql(sql)
    expected = rows_of(want.columns, want.fetchall())
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(want.columns):
        return f"{name}: columns {df.columns} and {want.columns}"
    got = rows_of(df.columns, df.collect())
    if got != expected:
        return f"{name}: {sum(got.values())} and {sum(expected.values())} rows; only here {list((got - expected).items())[:3]}; only there {list((expected - got).items())[:3]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    for n in names or [k for k in queries if k in oracles]:
        began = time.time()
        try:
            print(n, compare(session, n, queries[n], oracles[n], sf_dir) or "agrees", round(time.time() - began, 1), flush=True)
        except Exception as e:  # noqa: BLE001
            print(n, "FAILED", str(e)[:400].replace("\n", " "), flush=True)
