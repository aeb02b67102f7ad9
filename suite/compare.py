"""Runs the registered queries beside their SQL and says where they differ."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """(same, message) of one query and its SQL over a directory of tables."""
    start = time.time()
    frame = query(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} against {sorted(columns)}"
    a, b = rows_of(frame.columns, got), rows_of(columns, want)
    if a != b:
        only = [x for x in a if x not in b][:3], [x for x in b if x not in a][:3]
        return False, f"{len(a)} rows against {len(b)}; only here {only[0]}; only there {only[1]}"
    return True, f"{len(a)} rows, {took:.1f} s"


def connect(sf_dir):
    import duckdb

    from suite.inputs import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(sf_dir: str, *names: str) -> int:
    from pyspark.sql import SparkSession

    from suite.oracles import ORACLES
    from suite.queries import QUERIES

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    con, failed = connect(sf_dir), 0
    for name in names or QUERIES:
        if name not in ORACLES:
            print("rows only", name, len(QUERIES[name](spark, sf_dir).collect()))
            continue
        try:
            same, message = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
        except Exception as e:
            same, message = False, "".join(traceback.format_exception_only(e))[:1500]
        failed += not same
        print("same" if same else "DIFFERENT", name, message, flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
