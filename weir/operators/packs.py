"""Grouping messages into packs by count, interval or session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.duration import interval_micros, window_micros
from ..functions.expressions import micros
from ..plans.ordering import ordered
from ..plans.streams import Stream, arrival, require_id
from ..plans.tables import stored

PACK_ROWS = 100_000


def _array(message: Column, order: list[str]) -> Column:
    """The messages of a group as an array in arrival order."""
    numbered = F.struct(*order, message.alias("_message"))
    return F.transform(F.sort_array(F.collect_list(numbered)), lambda m: m["_message"])


def _packs(
    df: DataFrame, by: list[str], order: list[str], pack_rows: int, rows_per_chunk: int | None = None,
) -> DataFrame:
    """``by``, ``Part``, ``Pack``: the messages of a group in packs of ``pack_rows``, the last one
    shorter. ``Part`` counts a group's packs from 0 along the order, whatever the size or partitioning
    of the input."""
    if pack_rows < 1:
        raise ValueError("pack_rows must be positive")
    scan = ordered(df, order, by, rows_per_chunk).scan(_row=("sum", F.lit(1)))
    return (
        scan.df.withColumn("Part", F.floor((F.col("_row") - 1) / pack_rows).cast("int"))
        .groupBy(*by, "Part")
        .agg(_array(F.col("_message"), order).alias("Pack"))
    )


def pack_by_count(
    df: DataFrame, n: int, ts: str = "ts", id: str = "id", clears: DataFrame | None = None,
    flushes: DataFrame | None = None, flush_tail: bool = False, clear_ts: str = "ts",
    flush_ts: str = "ts", rows_per_chunk: int | None = None,
) -> DataFrame:
    """Packs of ``n`` messages in arrival order: ``epoch``, ``number`` and ``Pack``.

    A full pack is emitted when the next message arrives, so the last one stays unsent unless
    ``flush_tail`` is set. ``clears`` drop what is being collected; ``flushes`` emit it, also when
    it is empty (``Pack`` is null then). At equal time a clear comes first, then a flush, then
    the message. ``n`` = 0 collects nothing.
    """
    require_id(df, id)
    if n < 0:
        raise ValueError("the pack size must not be negative")
    if n == 0:
        df, n = df.limit(0), 1
    none = df.limit(0).select(F.lit(None).cast("timestamp").alias("ts"))
    clears = none if clears is None else clears.select(F.col(clear_ts).alias("ts"))
    flushes = none if flushes is None else flushes.select(F.col(flush_ts).alias("ts"))
    is_row = F.col("_rank") == 2
    scan = arrival(
        Stream(clears, "ts"), Stream(flushes, "ts"), Stream(df, ts, id),
        rows_per_chunk=rows_per_chunk,
    ).scan(epoch=("sum", (~is_row).cast("int")), _rows=("sum", is_row.cast("int")))
    # Rows up to the last marker before this row: a marker sees where the epoch it ends began.
    scan = scan.scan(exclusive=True, _start=("last", F.when(~is_row, F.col("_rows")))).df
    since = F.col("_rows") - F.coalesce("_start", F.lit(0))
    pack = lambda number, **what: F.struct(
        number.cast("bigint").alias("number"),
        *[what.get(k, F.lit(False)).alias(k) for k in ("member", "closes", "flushes", "ends")],
    )
    yes, mine = F.lit(True), F.floor((since - 1) / n)
    # A row belongs to its pack, and the first row of a pack closes the pack before it. A marker
    # ends the open pack of its epoch, and a flush sends it.
    row_says = F.when(
        (since > 1) & ((since - 1) % n == 0),
        F.array(pack(mine, member=yes), pack(mine - 1, closes=yes)),
    ).otherwise(F.array(pack(mine, member=yes)))
    marker_says = F.array(
        pack(F.greatest(mine, F.lit(0)), flushes=F.col("_rank") == 1, ends=yes)
    )
    says = scan.select(
        F.when(is_row, F.col("epoch")).otherwise(F.col("epoch") - 1).alias("epoch"),
        "_rows", F.col("_m2").alias("_message"),
        F.inline(F.when(is_row, row_says).otherwise(marker_says)),
    )
    member = F.when(F.col("member"), F.struct("_rows", "_message"))
    packs = says.groupBy("epoch", "number").agg(
        F.transform(F.sort_array(F.collect_list(member)), lambda m: m["_message"]).alias("Pack"),
        (F.max("closes") | F.max("flushes")).alias("_sent"), F.max("ends").alias("_ended"),
    )
    sent = F.col("_sent") | (F.lit(flush_tail) & ~F.col("_ended"))
    return packs.where(sent).select(
        "epoch", "number", F.when(F.size("Pack") > 0, F.col("Pack")).alias("Pack")
    )


def interval_start(ts: str, interval: str, start: Column | None = None) -> Column:
    """Begin of the tumbling interval that holds ``ts``; ``start`` sets the phase."""
    width = interval_micros(interval)
    origin = F.lit(0) if start is None else F.unix_micros(start)
    us = micros(ts)
    return F.timestamp_micros(us - F.pmod(us - origin, F.lit(width)))


def pack_by_interval(
    df: DataFrame, interval: str = "1s", ts: str = "ts", id: str = "id",
    start: Column | None = None, ticks: DataFrame | None = None, pack_rows: int = PACK_ROWS,
    rows_per_chunk: int | None = None, clears: DataFrame | None = None, flushes: DataFrame | None = None,
    clear_ts: str = "ts", flush_ts: str = "ts",
) -> DataFrame:
    """Tumbling packs: ``start``, ``Part``, ``Pack``.

    ``ticks`` (a ``tick_grid`` with ``ts`` at the interval starts) adds a row with a null Pack for
    every interval without messages; intervals that are no tick keep their packs. An interval of more
    than ``pack_rows`` messages comes as several parts of so many.

    ``clears`` drop what an interval has collected so far, ``flushes`` emit it, also when it is empty (``Pack`` is null then). Each
    begins another ``segment`` of the interval, a further column, counted from 0; the last one is emitted at the interval's end.
    At equal time a clear comes first, then a flush, then the message. ``start`` must be a constant then.
    """
    require_id(df, id)
    if clears is not None or flushes is not None:
        return _interval_segments(
            df, interval, ts, id, start, ticks, pack_rows, rows_per_chunk, clears, flushes, clear_ts, flush_ts)
    rows = df.select(
        interval_start(ts, interval, start).alias("start"),
        micros(ts).alias("_us"), F.col(id).alias("_id"), F.struct("*").alias("_message"),
    ).where(F.col("start").isNotNull())
    packs = _packs(rows, ["start"], ["_us", "_id"], pack_rows, rows_per_chunk)
    if ticks is None:
        return packs
    return ticks.select(F.col("ts").alias("start")).join(packs, "start", "full").withColumn(
        "Part", F.coalesce("Part", F.lit(0))
    )


def _interval_segments(
    df, interval, ts, id, start, ticks, pack_rows, rows_per_chunk, clears, flushes, clear_ts, flush_ts,
) -> DataFrame:
    """``start``, ``segment``, ``Part``, ``Pack``: intervals cut by clears and flushes."""
    rows = df.select(
        interval_start(ts, interval, start).alias("start"), micros(ts).alias("_us"), F.lit(2).alias("_rank"),
        F.col(id).alias("_id"), F.struct("*").alias("_message"))
    for rank, marks, at in ((0, clears, clear_ts), (1, flushes, flush_ts)):
        if marks is not None:
            rows = rows.unionByName(marks.select(
                interval_start(at, interval, start).alias("start"), micros(at).alias("_us"), F.lit(rank).alias("_rank"),
            ), allowMissingColumns=True)
    is_mark = F.col("_rank") < 2
    scan = ordered(rows.where(F.col("start").isNotNull()), ["_us", "_rank", "_id"], ["start"], rows_per_chunk).scan(
        _marks=("sum", is_mark.cast("int"))).df
    # a mark ends the segment before it
    scan = stored(scan.select(
        "start", (F.col("_marks") - is_mark.cast("int")).cast("bigint").alias("segment"), "_us", "_rank", "_id", "_message"), "segments")
    by = ["start", "segment"]
    packs = _packs(scan.where("_rank = 2").select(*by, "_us", "_id", "_message"), by, ["_us", "_id"], pack_rows, rows_per_chunk)
    ends = scan.where("_rank < 2").select(*by, (F.col("_rank") == 1).alias("_sent"))
    out = packs.join(ends, by, "full").where(F.coalesce("_sent", F.lit(True))).drop("_sent")
    if ticks is not None:
        marks = ends.groupBy("start").agg(F.count("*").alias("segment"))
        last = ticks.select(F.col("ts").alias("start")).join(marks, "start", "left").select(
            "start", F.coalesce("segment", F.lit(0)).cast("bigint").alias("segment"))
        out = out.join(last, by, "full")
    return out.select(*by, F.coalesce("Part", F.lit(0)).alias("Part"), "Pack")


def sessions(
    df: DataFrame, key: str, gap: str, ts: str = "ts", id: str = "id",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """``df`` with ``session``, the time of the first message of the row's session.

    A session of a key ends when the key is silent for longer than ``gap``; a message at exactly
    the gap still belongs to it. Keys with very many rows are cut along time, so a hot key is not
    one task.
    """
    require_id(df, id)
    if not isinstance(df.schema[key].dataType, T.StringType):
        raise ValueError("messages are packed by a text key")
    width = window_micros(gap)
    scan = arrival(Stream(df, ts, id, key), rows_per_chunk=rows_per_chunk)
    scan = scan.scan(exclusive=True, _prev=("max", F.col("_us")))
    is_start = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > width)
    scan = scan.scan(_session=("max", F.when(is_start, F.col("_us"))))
    return scan.df.select("_m0.*", F.timestamp_micros("_session").alias("session"))


def session_summary(
    df: DataFrame, key: str, gap: str, ts: str = "ts", id: str = "id",
    as_of: Column | None = None, rows_per_chunk: int | None = None,
) -> DataFrame:
    """One row per session: key, ``session`` start, ``last`` message time and ``Count``.

    ``as_of`` leaves out the sessions that are still open at that time.
    """
    out = (
        sessions(df, key, gap, ts, id, rows_per_chunk)
        .groupBy(key, "session")
        .agg(F.max(ts).alias("last"), F.count(F.lit(1)).cast("double").alias("Count"))
    )
    return _closed(out, gap, as_of)


def _closed(packs: DataFrame, gap: str, as_of: Column | None) -> DataFrame:
    if as_of is None:
        return packs
    return packs.where(F.unix_micros("last") + window_micros(gap) < F.unix_micros(as_of))


def pack_by_value(
    df: DataFrame, key: str, gap: str, ts: str = "ts", id: str = "id",
    as_of: Column | None = None, pack_rows: int = PACK_ROWS, rows_per_chunk: int | None = None,
) -> DataFrame:
    """Session packs: key, ``session``, ``Part``, ``Pack``.

    Sessions of more than ``pack_rows`` messages come as several parts of so many. ``as_of`` leaves out sessions still open at that time.
    """
    tagged = sessions(df, key, gap, ts, id, rows_per_chunk)
    rows = tagged.select(
        key, "session", micros(ts).alias("_us"), F.col(id).alias("_id"),
        F.struct(*df.columns).alias("_message"),
    )
    packs = _packs(rows, [key, "session"], ["_us", "_id"], pack_rows, rows_per_chunk)
    if as_of is None:
        return packs
    closed = session_summary(df, key, gap, ts, id, as_of, rows_per_chunk)
    return packs.join(closed.select(key, "session"), [key, "session"], "left_semi")
