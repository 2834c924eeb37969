"""Clock messages that drive polls."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.duration import interval_micros

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def to_micros(t: dt.datetime) -> int:
    """Epoch microseconds of a datetime; one without a zone is UTC."""
    t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def tick_grid(
    spark: SparkSession, start: dt.datetime, stop: dt.datetime, interval: str = "1s"
) -> DataFrame:
    """Ticks at ``start``, ``start + interval``, … up to ``stop`` inclusive (S6): ``tick``, ``ts``.

    The numbers come from a distributed range, so a long grid is spread over the executors.
    """
    step, first, last = interval_micros(interval), to_micros(start), to_micros(stop)
    n = max((last - first) // step + 1, 0)
    return spark.range(n).select(
        F.col("id").alias("tick"), F.timestamp_micros(F.lit(first) + F.col("id") * step).alias("ts")
    )


def ticks_over(df: DataFrame, interval: str, ts: str = "ts", per_row: int = 4_096) -> DataFrame:
    """Ticks on the multiples of ``interval`` that cover the times of ``df``: from the last one at
    or before the first message to the first one at or after the last message.

    Lazy: the limits come from one aggregation, and the numbers between them are produced in
    pieces of ``per_row`` that are spread over the executors.
    """
    step = interval_micros(interval)
    us = F.unix_micros(ts)
    limits = df.agg(
        F.floor(F.min(us) / step).alias("_a"), F.ceil(F.max(us) / step).alias("_b")
    ).where(F.col("_a").isNotNull())
    pieces = limits.select(
        "_a", "_b",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_b") - F.col("_a")) / per_row)))
        .alias("_piece"),
    ).repartition("_piece")
    first = F.col("_a") + F.col("_piece") * per_row
    last = F.least(F.col("_b"), first + (per_row - 1))
    return pieces.select("_a", F.explode(F.sequence(first, last)).alias("_n")).select(
        (F.col("_n") - F.col("_a")).alias("tick"),
        F.timestamp_micros(F.col("_n") * F.lit(step)).alias("ts"),
    )


def tick_stream(spark: SparkSession, interval: str = "1s") -> DataFrame:
    """Endless ticks as a streaming DataFrame, for intervals of a whole second or a whole number
    of ticks per second."""
    step = interval_micros(interval)
    if step >= 1_000_000 and step % 1_000_000 == 0:
        rows = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        seconds = step // 1_000_000
        rows = rows.where(F.col("value") % seconds == 0)
        tick = (F.col("value") / seconds).cast("bigint")
    elif 1_000_000 % step == 0:
        rows = spark.readStream.format("rate").option("rowsPerSecond", 1_000_000 // step).load()
        tick = F.col("value")
    else:
        raise ValueError("the interval must be whole seconds or divide one second")
    return rows.select(tick.alias("tick"), F.col("timestamp").alias("ts"))


def bang(df: DataFrame, at: Column) -> DataFrame:
    """One trigger message, ``ts`` and ``Bang`` = ``!`` (S7), at an aggregate of ``df``'s times,
    e.g. ``F.max("ts")``."""
    return df.agg(at.alias("ts")).select("ts", F.lit("!").alias("Bang"))
