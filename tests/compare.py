"""Run named queries and their SQL twins on the same tables and compare the rows.

Usage: python tests/compare.py [tables folder] [query name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """What differs, or None."""
    got = _rows(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, {len(want)} expected"
    if not want:
        return "no rows at all"
    for g, w in zip(got, want):
        if g != w:
            return f"{g} != {w}"
    return None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(folder), 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            sql = entry.oracle_sql().get(name)
            said = difference(df, con, sql) if sql else f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e).splitlines()[0][:400]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.2f}s  {said or 'ok'}"[:600], flush=True)
    print(f"{len(names)} queries, {bad} wrong")
    spark.stop()


if __name__ == "__main__":
    main()
