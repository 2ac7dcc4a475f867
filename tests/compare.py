"""Run registered queries next to their DuckDB text and compare the rows.

``python tests/compare.py FOLDER [PART_OF_NAME ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (datetime.date,)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(repr(plain(r[i])) for i in order) for r in rows)


def compare(spark, con, folder, name, query):
    df = query.run(spark, folder)
    left_cols, left = rows_of(df.columns, df.collect())
    if query.sql is None:
        return None, sum(left.values()), []
    cur = con.execute(query.sql)
    right_cols, right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return False, sum(left.values()), [left_cols, right_cols]
    if left == right:
        return True, sum(left.values()), []
    only_left, only_right = list((left - right).items()), list((right - left).items())
    return False, sum(left.values()), [left_cols, len(only_left), len(only_right), sum(right.values()),
                                       sorted(only_left)[:3], sorted(only_right)[:3]]


def main():
    from urlrisk.catalog import load
    from urlrisk.session import local_session
    folder, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(folder)
    bad = 0
    for name, query in load().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            ok, n, info = compare(spark, con, folder, name, query)
        except Exception as error:  # report every query
            ok, n, info = False, -1, [type(error).__name__, str(error)[:1500]]
        state = {True: "same", False: "DIFF", None: "rows"}[ok]
        print(f"{state} {name} rows={n} {time.time() - start:.1f}s", flush=True)
        if ok is False:
            bad += 1
            for line in info:
                print("    ", str(line)[:1800])
    print("different:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
