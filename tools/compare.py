"""Run registered queries on Spark and their SQL twins on DuckDB, and compare all rows.

    python tools/compare.py [scale folder] [query name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from pagelake.plans import catalog
from pagelake.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, connection, sf, name):
    started = time.time()
    result = catalog.queries()[name](spark, sf)
    columns, rows = _rows(result.columns, [tuple(r) for r in result.collect()])
    seconds = time.time() - started
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return f"rows {len(rows)}", seconds
    expected = connection.execute(sql)
    names = [d[0] for d in expected.description]
    names, wanted = _rows(names, expected.fetchall())
    if names != columns:
        return f"COLUMNS {columns} against {names}", seconds
    if rows != wanted:
        only = sorted(set(rows) - set(wanted))[:3], sorted(set(wanted) - set(rows))[:3]
        return f"DIFFERENT {len(rows)} against {len(wanted)}: {only}", seconds
    return f"equal {len(rows)}", seconds


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalog.queries())
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    for name in names:
        try:
            outcome, seconds = compare(spark, connection, sf, name)
            print(f"{name:28s} {seconds:6.2f}s  {outcome[:1500]}", flush=True)
        except Exception as failure:
            print(f"{name:28s}  FAILED {type(failure).__name__}: {str(failure)[:1200]}", flush=True)


if __name__ == "__main__":
    main()
