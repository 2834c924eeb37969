"""Windows, sessions and duplicates, with Spark's own streaming operators.

``ts`` is the arrival time, so a watermark delay only has to cover how far rows of different files or
partitions are out of order. Rows behind the watermark are dropped by these operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.duration import interval_micros, window_micros


def count_stream(
    df: DataFrame, window: str, every: str, ts: str = "ts", by: list[str] | None = None,
    delay: str = "0 seconds",
) -> DataFrame:
    """Messages of the last ``window`` at every multiple of ``every``: ``poll``, ``by``, ``Count``.

    Both ends of the window are included, as for ``count_at``. Polls without a live message give no
    row. Each message serves window / every polls.
    """
    width, step = window_micros(window), interval_micros(every)
    if step > width + 1:
        raise ValueError("the polls must not be further apart than the window")
    span = F.window(ts, f"{width + 1} microseconds", f"{step} microseconds",
                    f"{-width % step} microseconds")
    counts = df.withWatermark(ts, delay).groupBy(span, *(by or [])).agg(
        F.count(F.lit(1)).cast("double").alias("Count")
    )
    poll = F.timestamp_micros(F.unix_micros("window.end") - 1)
    return counts.select(poll.alias("poll"), *(by or []), "Count")


def pack_by_interval_stream(
    df: DataFrame, interval: str, ts: str = "ts", id: str = "id", by: list[str] | None = None,
    parts: int = 1, delay: str = "0 seconds",
) -> DataFrame:
    """Tumbling packs: ``start``, ``by``, ``Part``, ``Pack`` in arrival order, sent when the interval
    is over.

    A pack is one row. With ``parts`` > 1 the messages of an interval are spread over so many packs
    by their id, so that a busy interval is not one row. Empty intervals give no row.
    """
    message = F.struct(ts, id, F.struct("*").alias("_message"))
    part = F.pmod(F.xxhash64(id), F.lit(parts)).cast("int").alias("Part")
    packs = df.withWatermark(ts, delay).groupBy(
        F.window(ts, f"{interval_micros(interval)} microseconds"), *(by or []), part
    ).agg(F.sort_array(F.collect_list(message)).alias("_m"))
    return packs.select(
        F.col("window.start").alias("start"), *(by or []), "Part",
        F.transform("_m", lambda m: m["_message"]).alias("Pack"),
    )


def session_stream(
    df: DataFrame, key: str, gap: str, ts: str = "ts", delay: str = "0 seconds"
) -> DataFrame:
    """Sessions per key: ``key``, ``session``, ``last``, ``Count``, sent when the key has been silent
    for longer than the gap. Open sessions stay in the state."""
    sessions = df.withWatermark(ts, delay).groupBy(
        key, F.session_window(ts, f"{window_micros(gap)} microseconds").alias("_w")
    ).agg(F.max(ts).alias("last"), F.count(F.lit(1)).cast("double").alias("Count"))
    return sessions.select(key, F.col("_w.start").alias("session"), "last", "Count")


def dedupe_stream(
    df: DataFrame, key: str, ts: str | None = None, within: str | None = None
) -> DataFrame:
    """One message per key. Without ``within`` every key is remembered for ever; with it, a key is
    forgotten when no more duplicate can come within that time of ``ts``. Of duplicates in one
    micro-batch, which of them passes is not defined."""
    df = df.where(F.col(key).isNotNull())
    if within is None:
        return df.dropDuplicates([key])
    return df.withWatermark(ts, f"{interval_micros(within)} microseconds").dropDuplicatesWithinWatermark(
        [key]
    )
