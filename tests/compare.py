"""Run registered queries in Spark and their SQL in DuckDB and compare rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(r) for r in df.select(*columns).collect()), key=_key)


def duck_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.sql(sql).create_view("result", replace=True)  # as the driver does
    columns = sorted(result.columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    return columns, sorted(result.project(picked).fetchall(), key=_key)


def difference(spark: tuple, duckdb_side: tuple) -> str | None:
    """None when columns and all values are equal, doubles bit for bit."""
    if spark[0] != duckdb_side[0]:
        return f"columns {spark[0]} != {duckdb_side[0]}"
    if len(spark[1]) != len(duckdb_side[1]):
        return f"{len(spark[1])} rows in Spark, {len(duckdb_side[1])} in DuckDB"
    for mine, theirs in zip(spark[1], duckdb_side[1], strict=True):
        if mine != theirs and not all(
            a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))
            for a, b in zip(mine, theirs, strict=True)
        ):
            return f"{spark[0]}\n  spark  {mine}\n  duckdb {theirs}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            mine = spark_rows(query(spark, sf_dir))
            middle = time.time()
            problem = difference(mine, duck_rows(con, sql[name])) if name in sql else "no SQL"
        except Exception as error:  # noqa: BLE001 - reported per query
            middle, mine, problem = time.time(), ([], []), f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        print(
            f"{'FAIL' if problem else 'ok  '} {name:28s} rows={len(mine[1]):7d} "
            f"spark={middle - start:5.2f}s duckdb={time.time() - middle:5.2f}s",
            problem or "", flush=True,
        )
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
