"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import scratch_path

#: Measured bytes up to which a table is broadcast.
BROADCAST_BYTES = 64 << 20


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever else the table has (names that differ in case, too)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written below ``spark.checkpoint.dir`` and read again: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Marked for broadcast if its counted rows stay under BROADCAST_BYTES; else as it is, for a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, as texts can be long; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
