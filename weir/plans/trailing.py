"""Aggregates over the live rows of a trailing time window, read at poll times.

At poll time ``p`` the live rows are those with ``p - W <= t <= p``, both ends included. A range
frame would re-add the whole frame for every poll, and a busy window would be one task.

Counts are a difference: the rows up to ``p`` less the rows before ``p - W``, both read from one
running count along time. Whole numbers are exact, so the lower end may also be another time, such as
that of the last clear.

Float sums must not be subtracted, as rounding errors would pile up. For them time is cut into blocks of
``W + 1`` microseconds. Every window is then the end of one block plus the start of the next, i.e. one
running sum counted backwards in time and one counted forwards. Busy blocks are cut into chunks.

When there are few polls, rows that no poll can tell apart are first summed up into one row per
(key, slot between neighbouring limits). This is a partial aggregation on the map side, so the raw
rows are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import array_literal, with_count_le
from .ordering import ordered

MAX_SLOT_POLLS = 4_096


def few_polls(polls: DataFrame, us: str) -> list[int] | None:
    """The distinct poll times when there are at most MAX_SLOT_POLLS, else None."""
    rows = polls.select(us).distinct().limit(MAX_SLOT_POLLS + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= MAX_SLOT_POLLS else None


def few_spans(polls: DataFrame) -> list[tuple[int, int]] | None:
    """The distinct ``(_lo, _us)`` of polls when there are at most MAX_SLOT_POLLS, else None."""
    rows = polls.select("_lo", "_us").distinct().limit(MAX_SLOT_POLLS + 1).collect()
    return sorted((r[0], r[1]) for r in rows) if len(rows) <= MAX_SLOT_POLLS else None


def _asked(polls: DataFrame, cols: list[str], id_type, few: bool) -> DataFrame:
    """The polls, so that no instant can pile up in one chunk: with an ``_id`` of their own they can
    be cut apart, otherwise each time is taken once."""
    if "_id" in polls.columns and not few:
        return polls.select(*cols, "_id")
    return polls.select(*cols).distinct().withColumn("_id", F.lit(None).cast(id_type))


def _slots(
    values: DataFrame, by: list[str], spans: list[tuple[int, int]], sums: dict[str, Column]
) -> DataFrame:
    """One row per key and slot, for polls that each see the times of one span. A slot holds the
    times between two neighbouring span limits, so every poll sees all of it or nothing."""
    cuts = sorted({hi + 1 for _, hi in spans} | {lo for lo, _ in spans})
    if spans:
        values = values.where(F.col("_us").between(cuts[0], cuts[-1] - 1))
    bounds = array_literal(cuts, "array<bigint>")
    return (
        with_count_le(values, "_slot", bounds, len(cuts), F.col("_us"))
        .groupBy(*by, "_slot")
        .agg(F.min("_us").alias("_us"), *[c.alias(n) for n, c in sums.items()])
        .withColumnRenamed("_slot", "_id")
    )


def span_counts(
    events: DataFrame,
    polls: DataFrame,
    by: list[str] | None = None,
    spans: list[tuple[int, int]] | None = None,
    rows_per_chunk: int | None = None,
    tasks: int = 0,
) -> DataFrame:
    """Number of events with ``_lo <= t <= _us`` for every distinct ``(by, _lo, _us)`` of ``polls``:
    ``by``, ``_us``, ``_n``.

    ``events`` has ``by``, ``_us`` and a unique ``_id``; ``polls`` may have a unique ``_id`` too. ``spans`` are all the ``(_lo, _us)`` when they
    are few (see ``few_spans``); each key then has at most a few rows per poll. With ``tasks``, the polls are known to be
    distinct, and the rows are dealt to at least so many tasks by key.
    """
    by = list(by or [])
    values = events.select(*by, "_us", "_id")
    if spans is not None:
        values = _slots(values, by, spans, {"_w": F.count(F.lit(1))})
    else:
        values = values.withColumn("_w", F.lit(1).cast("bigint"))
    rows = values.select(*by, F.col("_us").alias("_t"), F.lit(1).alias("_rank"), "_id", "_w",
                         F.lit(None).cast("bigint").alias("_poll"))
    ends = F.array(
        F.struct(F.col("_us").alias("_t"), F.lit(2).alias("_rank")),
        F.struct(F.col("_lo").alias("_t"), F.lit(0).alias("_rank")),
    )
    id_type = values.schema["_id"].dataType
    cols = [*by, "_lo", "_us"]
    asked = polls.select(*cols, F.lit(None).cast(id_type).alias("_id")) if tasks else _asked(polls, cols, id_type, spans is not None)
    reads = asked.select(
        *by, F.col("_us").alias("_poll"), "_id", F.inline(ends)
    ).select(*by, "_t", "_rank", "_id", F.lit(0).cast("bigint").alias("_w"), "_poll")
    scan = ordered(
        rows.unionByName(reads), ["_t", "_rank", "_id"], by, rows_per_chunk,
        bounded=spans is not None, tasks=tasks,
    ).scan(_seen=("sum", F.col("_w")))
    # Polls of the same time read the same values, so the largest of them is the one.
    read = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("_seen")))
    return (
        scan.df.where(F.col("_rank") != 1)
        .groupBy(*by, F.col("_poll").alias("_us"))
        .agg((read(2) - read(0)).alias("_n"))
    )


def trailing_sums(
    events: DataFrame,
    polls: DataFrame,
    window_us: int,
    sums: dict[str, Column],
    by: list[str] | None = None,
    poll_times: list[int] | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Sums over the live events for every distinct ``(by, _us)`` of ``polls``.

    ``events`` has ``by``, ``_us`` and a unique ``_id``; ``polls`` has ``by``, ``_us`` and
    maybe a unique ``_id``. The result has ``by``, ``_us`` and the sums, 0 where no live row has a value. ``poll_times``
    are all the poll times when they are few (see ``few_polls``).
    """
    by = list(by or [])
    block_us = window_us + 1
    values = events.select(*by, "_us", "_id", *[c.alias(n) for n, c in sums.items()])
    if poll_times is not None:
        values = _slots(values, by, [(p - window_us, p) for p in poll_times],
                        {n: F.sum(n) for n in sums})
    id_type = values.schema["_id"].dataType
    start = lambda us: us - F.pmod(us, F.lit(block_us))
    us = F.col("_us")
    both = values.select(
        *by,
        F.explode(F.array(F.lit(1), F.lit(-1))).alias("_dir"),
        start(us).alias("_block"),
        us.alias("_t"),
        F.lit(0).alias("_rank"),
        "_id",
        F.lit(None).cast("bigint").alias("_poll"),
        *sums,
    ).withColumn("_t", F.col("_t") * F.col("_dir"))
    sides = F.array(
        F.struct(F.lit(1).alias("_dir"), us.alias("_t")),
        F.struct(F.lit(-1).alias("_dir"), (us - window_us).alias("_t")),
    )
    reads = (
        _asked(polls, [*by, "_us"], id_type, poll_times is not None)
        .select(*by, us.alias("_poll"), "_id", F.explode(sides).alias("_side"))
        .select(
            *by,
            "_side._dir",
            start(F.col("_side._t")).alias("_block"),
            (F.col("_side._t") * F.col("_side._dir")).alias("_t"),
            F.lit(1).alias("_rank"),
            "_id",
            "_poll",
            *[F.lit(None).cast(values.schema[n].dataType).alias(n) for n in sums],
        )
        .where((F.col("_dir") == 1) | (F.col("_block") != start(F.col("_poll"))))
    )
    scan = ordered(
        both.unionByName(reads),
        ["_t", "_rank", "_id"],
        [*by, "_dir", "_block"],
        rows_per_chunk,
        bounded=poll_times is not None,
    ).scan(**{f"_run_{n}": ("sum", F.col(n)) for n in sums})
    # Polls of the same time read the same values, so the largest of them is the one.
    read = lambda way, n: F.max(F.when(F.col("_dir") == way, F.col(f"_run_{n}")))
    return (
        scan.df.where(F.col("_rank") == 1)
        .groupBy(*by, F.col("_poll").alias("_us"))
        .agg(*[
            (read(1, n) + F.coalesce(read(-1, n), F.lit(0))).alias(n) for n in sums
        ])
    )
