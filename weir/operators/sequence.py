"""Operators whose result depends on the order of all messages."""

from __future__ import annotations

from collections import deque
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.duration import interval_micros, parse_duration, window_micros
from ..functions.expressions import as_col, micros
from ..plans.lookups import lookup_join
from ..plans.ordering import with_index
from ..plans.streams import Stream, arrival, of_stream, require_id


def sync(
    df: DataFrame, time_ms: str, lag: str, ts: str = "ts", id: str = "id", positions: bool = False,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Order messages by their own epoch-millisecond time, released ``lag`` later (O1).

    Adds ``release`` and ``late``. A message that arrives after its release time is not dropped
    but released on arrival. Messages without a numeric time are skipped. The order is
    ``(release, time, id)``: with ``positions`` the column ``pos`` numbers it, otherwise sort by
    these columns where an order is needed.
    """
    own = F.round(as_col(time_ms).try_cast("double") * 1000).cast("bigint")
    due = F.col("_own") + parse_duration(lag)
    out = (
        df.withColumn("_own", own)
        .where(F.col("_own").isNotNull())
        .withColumns({
            "release": F.timestamp_micros(F.greatest(due, micros(ts))),
            "late": micros(ts) > due,
        })
    )
    if positions:
        order = ["_release_us", "_own", require_id(df, id)]
        out = out.withColumn("_release_us", micros("release"))
        out = with_index(out, order, "pos", rows_per_chunk).drop("_release_us")
    return out.drop("_own")


def _queue_state(pushes, pops, ts, id, rows_per_chunk, polls=None, poll_ts="ts"):
    """Pushes (rank 0), pops (1) and polls (2) with the pushes and served pops up to each row.

    With +1 for a push and -1 for a pop, a pop finds the queue empty exactly when the running sum
    falls below all its earlier values (and below 0). So the pops that went unserved so far are
    minus the lowest running sum, and the other pops were served in order.
    """
    streams = [Stream(pushes, ts, require_id(pushes, id)), Stream(pops, ts, require_id(pops, id))]
    if polls is not None:
        streams.append(Stream(polls, poll_ts))
    is_push, is_pop = F.col("_rank") == 0, F.col("_rank") == 1
    scan = arrival(*streams, rows_per_chunk=rows_per_chunk).scan(
        _pushes=("sum", is_push.cast("int")), _pops=("sum", is_pop.cast("int")),
    )
    depth = F.col("_pushes") - F.col("_pops")
    scan = scan.scan(exclusive=True, _low=("min", depth)).df
    low_before = F.least(F.coalesce("_low", F.lit(0)), F.lit(0))
    return scan.select(
        "*",
        (depth >= low_before).alias("_served"),
        (F.col("_pops") + F.least(low_before, depth)).alias("_taken"),
    )


def queue_pops(
    pushes: DataFrame, pops: DataFrame, ts: str = "ts", id: str = "id",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """FIFO queue: one row per served pop, ``k``, ``pop`` and the ``message`` it got (O2).

    A pop on an empty queue does nothing. At equal time pushes come before pops.
    """
    state = _queue_state(pushes, pops, ts, id, rows_per_chunk)
    is_push = F.col("_rank") == 0
    # The pop and its message meet in a group of two.
    both = state.where(is_push | F.col("_served")).select(
        (F.when(is_push, F.col("_pushes")).otherwise(F.col("_taken")) - 1).alias("k"), "_m0", "_m1"
    )
    return both.groupBy("k").agg(
        F.first("_m1", ignorenulls=True).alias("pop"),
        F.first("_m0", ignorenulls=True).alias("message"),
    ).where(F.col("pop").isNotNull())


def queue_peek(
    pushes: DataFrame, pops: DataFrame, polls: DataFrame, ts: str = "ts", id: str = "id",
    poll_ts: str = "ts", rows_per_chunk: int | None = None,
) -> DataFrame:
    """``polls`` with ``message``, the oldest stored message at each poll; null when empty."""
    state = _queue_state(pushes, pops, ts, id, rows_per_chunk, polls, poll_ts)
    stored = state.where("_rank = 0").select(
        (F.col("_pushes") - 1).alias("_k"), F.col("_m0").alias("message")
    )
    head = F.when(F.col("_pushes") > F.col("_taken"), F.col("_taken"))
    reads = of_stream(state, 2, head.alias("_k"))
    stored = stored.withColumnRenamed("_k", "_stored")
    return lookup_join(reads, stored, ["_k"], ["_stored"]).select(*polls.columns, "message")


def toggle(
    df: DataFrame, ts: str = "ts", id: str = "id", rows_per_chunk: int | None = None
) -> DataFrame:
    """``df`` with ``state``, true for the first message and flipped by every further one (O3)."""
    scan = arrival(Stream(df, ts, require_id(df, id)), rows_per_chunk=rows_per_chunk)
    scan = scan.scan(_n=("sum", F.lit(1))).df
    return of_stream(scan, 0, (F.col("_n") % 2 == 1).alias("state"))


def every_nth(
    df: DataFrame, n: int, ts: str = "ts", id: str = "id", rows_per_chunk: int | None = None
) -> DataFrame:
    """The n-th, 2n-th, … message: a counter that fires at ``n`` and is cleared by firing, when
    no message expires in between."""
    scan = arrival(Stream(df, ts, require_id(df, id)), rows_per_chunk=rows_per_chunk)
    scan = scan.scan(_n=("sum", F.lit(1))).df
    return of_stream(scan.where(F.col("_n") % n == 0), 0)


def fire_at_ticks(
    df: DataFrame, key: str, threshold: int, tick: str, window: str, ts: str = "ts"
) -> DataFrame:
    """A counter per key that is polled at every ``tick`` and cleared by firing: ``key``, ``at``,
    ``Count`` for each poll at which at least ``threshold`` messages of the last ``window`` have come
    since the last firing.

    Firing feeds back into the count, so a key's polls must be taken one after the other. Its messages
    are first added up per tick on the map side: a task gets at most two rows per key and tick, however
    many messages there are. The window must be a whole number of ticks.
    """
    step, width = interval_micros(tick), window_micros(window)
    if width % step:
        raise ValueError("the window must be a whole number of ticks")
    span = width // step
    us = micros(ts)
    # Messages at a tick are live one poll longer than those between two ticks.
    counts = df.select(
        F.col(key).alias("key"), F.ceil(us / F.lit(step)).alias("_tick"),
        (F.pmod(us, F.lit(step)) == 0).alias("_exact"),
    ).where(F.col("key").isNotNull() & F.col("_tick").isNotNull()).groupBy(
        "key", "_tick", "_exact"
    ).agg(F.count(F.lit(1)).alias("_n"))
    kind = counts.schema["key"].dataType.simpleString()

    def fire(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_tick")
        out, live, total = [], deque(), 0  # live: (first poll that no longer sees it, count)
        slots = list(zip(rows["_tick"], rows["_exact"], rows["_n"]))
        # The count only grows where messages arrive, so no other poll can fire.
        for at, group in groupby(slots, key=lambda s: s[0]):
            for _, exact, n in sorted(group, key=lambda s: s[1]):
                live.append((at + span + int(exact), n))
                total += n
            while live and live[0][0] <= at:
                total -= live.popleft()[1]
            if total >= threshold:
                out.append((keys[0], at, float(total)))
                live.clear()
                total = 0
        return pd.DataFrame(out, columns=["key", "tick", "Count"])

    fired = counts.groupBy("key").applyInPandas(fire, f"key {kind}, tick bigint, Count double")
    return fired.select(
        "key", F.timestamp_micros(F.col("tick") * F.lit(step)).alias("at"), "Count"
    )
