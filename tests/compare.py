"""Run queries in Spark and their SQL in DuckDB, and compare rows exactly.

``python tests/compare.py [sf] [name ...]`` prints a line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is not None, str(v)) for v in r))


def check(con, df, sql: str) -> str:
    names, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    expected_names = [c[0] for c in result.description]
    expected_types = {c[0]: str(c[1]) for c in result.description}
    expected_names, theirs = rows_of(expected_names, result.fetchall())
    if names != expected_names:
        return f"columns differ: {names} / {expected_names}"
    types = dict(df.dtypes)
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "boolean": "BOOLEAN"}
    odd = {c: (types[c], expected_types[c]) for c in names
           if same.get(types[c], types[c]) not in expected_types[c].upper() and expected_types[c] != "STRING"}
    if odd and "NUMBER" not in str(odd):
        return f"types differ: {odd}"
    if len(mine) != len(theirs):
        return f"rows differ: {len(mine)} / {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"values differ: {dict(zip(names, zip(a, b)))}"
    return f"ok {len(mine)} rows"


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = f"/root/testdata/sf{args[0] if args else '0.01'}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = oracle(sf_dir), e.oracle_sql()
    bad = 0
    for name, run in e.queries().items():
        if args[1:] and not any(name.startswith(a) for a in args[1:]):
            continue
        start = time.time()
        try:
            if name in sql:
                status = check(con, run(spark, sf_dir), sql[name])
            else:
                status = f"ok {len(run(spark, sf_dir).collect())} rows (no SQL)"
        except Exception as error:
            status = f"{type(error).__name__}: {str(error)[:600]}"
        bad += not status.startswith("ok")
        print(f"{name:32s} {time.time() - start:6.2f}s {status}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
