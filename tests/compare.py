"""Runs every named query on Spark and its SQL on DuckDB and compares the results.

    python -m tests.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("riskloom")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return str(value)


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()
    )


def difference(spark, con, sf_dir: str, name: str, queries: dict, oracle: dict) -> str | None:
    """None when both sides agree, else a short description."""
    names, ours = spark_rows(queries[name](spark, sf_dir))
    if name not in oracle:
        return None
    columns, theirs = duck_rows(con, oracle[name])
    if names != columns:
        return f"columns {names} against {columns}"
    kinds = {tuple(type(v).__name__ for v in row) for row in list(ours)[:1]}
    kinds_sql = {tuple(type(v).__name__ for v in row) for row in list(theirs)[:1]}
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        return (
            f"{sum(ours.values())} rows against {sum(theirs.values())}; only here "
            f"{sum(extra.values())} {list(extra)[:2]}; only there {sum(missing.values())} {list(missing)[:2]}"
        )
    if not ours:
        return "EMPTY on both sides"
    if kinds != kinds_sql and "NoneType" not in str(kinds | kinds_sql):
        return f"types {kinds} against {kinds_sql}"
    return None


def main(sf_dir: str, chosen: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = session(), duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in chosen or queries:
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, name, queries, oracle)
        except Exception as error:  # noqa: BLE001 - reported per query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        state = "ok" if problem is None else "DIFFERENT"
        print(f"{state:9} {time.time() - start:6.1f}s {name} {(problem or '')[:900]}", flush=True)
    print(f"{failed} of {len(chosen or queries)} differ")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
