"""Compare registered queries with their SQL in DuckDB: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return str(v) if v is not None and not isinstance(v, (int, bool)) else v


def rows_of(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(con, spark, name: str, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    spark_cols, spark_rows = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    duck_cols, duck_rows = rows_of([d[0] for d in result.description], result.fetchall())
    if spark_cols != duck_cols:
        return f"columns {spark_cols} != {duck_cols}"
    if spark_rows != duck_rows:
        ours, theirs = spark_rows - duck_rows, duck_rows - spark_rows
        return (
            f"{sum(spark_rows.values())} vs {sum(duck_rows.values())} rows; "
            f"only ours {list(ours.items())[:3]}; only theirs {list(theirs.items())[:3]}"
        )
    return None


def main() -> None:
    import __spark_entry__ as entry
    from pulselake.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf_dir), entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            problem = differences(con, spark, name, query, sql[name], sf_dir) if name in sql else "no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
