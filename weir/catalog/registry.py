"""Named queries over the test tables, each with its plain SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from ..sources.ticks import ticks_over

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def of_type(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    return events(spark, d).where(F.col("event_type").isin(*kinds))


def ticks(spark: SparkSession, d: str, interval: str) -> DataFrame:
    return ticks_over(events(spark, d).select("ts"), interval)


def us(col: str = "ts", name: str = "t_us") -> Column:
    return F.unix_micros(col).alias(name)


def rounded(col: str | Column, name: str, digits: int = 6) -> Column:
    """Float results are compared to so many decimals; the tiny shift keeps ties apart."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c + F.lit(1e-9), digits).alias(name)


def sql_ticks(interval_us: int, name: str = "polls") -> str:
    """SQL for the ticks of ``ticks``: a table of ``p``, epoch microseconds."""
    return (
        f"{name} AS (SELECT unnest(range(a // {interval_us}, (b + {interval_us - 1}) // "
        f"{interval_us} + 1)) * {interval_us} AS p FROM "
        "(SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events))"
    )


HOUR = 3_600_000_000
MINUTE = 60_000_000
SQL_EVENTS = "e AS (SELECT *, epoch_us(ts) AS t FROM events)"
