"""Run queries on Spark and their SQL on DuckDB and compare names, types and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """First difference found, or None."""
    kinds = dict(df.dtypes)
    want_kinds = {row[0]: row[1] for row in con.execute(f"describe {sql}").fetchall()}
    if set(kinds) != set(want_kinds):
        return f"columns {sorted(kinds)} != {sorted(want_kinds)}"
    for c, k in want_kinds.items():
        if KINDS.get(k, k) != kinds[c]:
            return f"type of {c}: {kinds[c]} != {k}"
    got = _rows(df.columns, [tuple(x) for x in df.collect()])
    names = list(want_kinds)
    want = _rows(names, con.execute(sql).fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(wrong)} of {len(want)} rows differ, first {wrong[0]}" if wrong else None


def main(folder: str, names: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).parent.parent))
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.perf_counter()
        try:
            df = run(spark, folder)
            if name in sqls:
                result = difference(df, con, sqls[name])
            else:
                result, n = None, len(df.collect())
                if not n:
                    result = "no rows"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:600]}"
        bad += result is not None
        print(f"{'ok ' if result is None else 'BAD'} {name:28s} {time.perf_counter() - start:6.2f}s {'' if name in sqls else '(rows)'} {result or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
