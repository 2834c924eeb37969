"""Counts, histograms, averages and recent values, read at poll times.

A block of the reference keeps state and emits it when polled. Here the polls are a DataFrame, and
every ``*_at`` operator returns its rows with the state as of each poll. Arrival order is
``(ts, id)`` with a unique ``id``; a message at exactly the poll's time counts as before the poll.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.duration import window_micros
from ..functions.expressions import array_literal, as_col, label_text, micros, with_count_le
from ..plans.lookups import lookup_join
from ..plans.ordering import ROWS_PER_TASK, ordered, spread
from ..plans.rolling import rolling_sums
from ..plans.streams import Stream, arrival, merged, of_stream, require_id
from ..plans.tables import stored
from ..plans.trailing import few_polls, few_spans, span_counts, trailing_sums

RECENT_ROWS = 200_000
EPS = 0.0001  # Fixed value: stands in for a zero count in kl_divergence.


def _with_result(polls: DataFrame, result: DataFrame, poll_ts: str, *names: str) -> DataFrame:
    """``polls`` with the columns ``names`` of a result that has one row per poll time ``_us``."""
    found = result.select(F.col("_us").alias("_of_us"), *names)
    asked = polls.withColumn("_us", micros(poll_ts))
    return lookup_join(asked, found, ["_us"], ["_of_us"])


def count_at(
    events: DataFrame, polls: DataFrame, window: str, ts: str = "ts", id: str = "id",
    poll_ts: str = "ts", clears: DataFrame | None = None, clear_ts: str | None = None,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """``polls`` with ``Count``, the number of messages of the last ``window`` (A1).

    ``clears`` empty the count; a clear at a message's time comes before the message. A window
    of 0 counts the messages at exactly the poll's instant.
    """
    return _count(events, polls, window, ts, id, poll_ts, clears, clear_ts, False, rows_per_chunk)


def rolling_count(events: DataFrame, window: str, ts: str = "ts", id: str = "id",
                  rows_per_chunk: int | None = None) -> DataFrame:
    """``count_at`` with a poll right after every message.

    The messages are shuffled once, by time, with a halo of one window (``plans/rolling.py``). Only a window so long that it
    holds several chunks of messages takes the plan of ``count_at`` instead. Looks at the data first: a count and a sample.
    """
    require_id(events, id)
    found = rolling_sums(events, ts, id, window_micros(window), None, rows_per_chunk)
    if found is not None:
        return found.select(*events.columns, F.col("_n").cast("double").alias("Count"))
    return _count(events, events, window, ts, id, ts, None, None, True, rows_per_chunk)


def _count(events, polls, window, ts, id, poll_ts, clears, clear_ts, every_message, rows_per_chunk):
    require_id(events, id)
    width = window_micros(window)
    lowest = F.col("_us") - width
    ids = [F.col(id).alias("_id")] if every_message else []
    spans = polls.select(micros(poll_ts).alias("_us"), *ids)
    if clears is not None:
        # Only polls and clears are put in order here, not the events.
        scan = arrival(
            Stream(clears.select(F.col(clear_ts or ts).alias("ts")), "ts"),
            Stream(polls.select(F.col(poll_ts).alias("ts")), "ts"), rows_per_chunk=rows_per_chunk,
        ).scan(_cleared=("max", F.when(F.col("_rank") == 0, F.col("_us")))).df
        spans = scan.where("_rank = 1").select("_us", "_cleared")
        lowest = F.greatest(lowest, F.col("_cleared"))
    spans = spans.where(F.col("_us").isNotNull()).withColumn("_lo", lowest)
    counts = span_counts(
        events.select(micros(ts).alias("_us"), F.col(id).alias("_id")), spans,
        spans=None if every_message else few_spans(spans), rows_per_chunk=rows_per_chunk,
    )
    count = F.coalesce(F.col("_n"), F.lit(0)).cast("double").alias("Count")
    return _with_result(polls, counts, poll_ts, "_n").select(*polls.columns, count)


def _averages(events, polls, value, window, ts, id, poll_ts, every_message, rows_per_chunk):
    require_id(events, id)
    valid = events.select(
        micros(ts).alias("_us"), F.col(id).alias("_id"),
        as_col(value).try_cast("double").alias("_value"),
    ).where(F.col("_value").isNotNull())
    ids = [F.col(id).alias("_id")] if every_message else []
    asked = polls.select(micros(poll_ts).alias("_us"), *ids)
    live = trailing_sums(
        valid, asked, window_micros(window), {"_n": F.lit(1), "_total": F.col("_value")},
        poll_times=None if every_message else few_polls(asked, "_us"),
        rows_per_chunk=rows_per_chunk,
    )
    average = F.try_divide("_total", "_n").alias("Average")
    return _with_result(polls, live, poll_ts, "_n", "_total").select(*polls.columns, average)


def moving_average_at(
    events: DataFrame, polls: DataFrame, value: str | Column, window: str, ts: str = "ts",
    id: str = "id", poll_ts: str = "ts", rows_per_chunk: int | None = None,
) -> DataFrame:
    """``polls`` with ``Average``, the mean of the live values (A3).

    Values that are no numbers are skipped. Without a live value the result is null (the
    reference gives 0/0).
    """
    return _averages(events, polls, value, window, ts, id, poll_ts, False, rows_per_chunk)


def rolling_average(events: DataFrame, value: str | Column, window: str, ts: str = "ts",
                    id: str = "id", rows_per_chunk: int | None = None) -> DataFrame:
    """``moving_average_at`` with a poll right after every message; see ``rolling_count`` for the plan."""
    require_id(events, id)
    number = as_col(value).try_cast("double")
    found = rolling_sums(events, ts, id, window_micros(window), number, rows_per_chunk)
    if found is not None:
        return found.select(*events.columns, F.try_divide("_total", "_n").alias("Average"))
    return _averages(events, events, value, window, ts, id, ts, True, rows_per_chunk)


def histogram_at(
    events: DataFrame, polls: DataFrame, value: str, window: str, ts: str = "ts", id: str = "id",
    poll_ts: str = "ts", long: bool = False, rows_per_chunk: int | None = None,
) -> DataFrame:
    """Per distinct value the number of live messages at each poll (A2).

    A label once seen stays, with Count 0 when none of its messages is live. Values may be text,
    booleans, integers or floats (see ``label_text``); others are skipped. The default is one row
    per poll with ``Histogram``, an array of ``{Label, Count}`` sorted by label. ``long=True``
    gives one row per poll and label instead and suits any number of labels; a poll before the
    first message has no rows then.
    """
    require_id(events, id)
    width = window_micros(window)
    kind = events.select(value).schema[0].dataType.simpleString()
    labelled = events.select(
        label_text(value, kind).alias("Label"), micros(ts).alias("_us"), F.col(id).alias("_id")
    ).where(F.col("Label").isNotNull())
    first = labelled.groupBy("Label").agg(F.min("_us").alias("_first"))
    asked = polls.withColumn("_us", micros(poll_ts))
    times = few_polls(asked, "_us")
    tasks = 0
    if times is None:
        reads = _later_polls(first, asked.select("_us").distinct(), rows_per_chunk)
    elif not times:
        reads = first.select("Label", F.col("_first").alias("_us")).where(F.lit(False))
    else:
        all_times = array_literal(times, "array<bigint>")
        first = stored(with_count_le(first, "_before", all_times, len(times), F.col("_first") - 1), "labels")
        # Every label has two reads for each later poll, and at most one slot before each read.
        n = first.agg(F.sum(F.lit(4) * (F.lit(len(times)) - F.col("_before")))).first()[0] or 0
        tasks = max(1, math.ceil(n / ROWS_PER_TASK))
        first = spread(first, ["Label"], tasks)
        later = F.slice(all_times, F.col("_before") + 1, F.lit(len(times)))
        reads = first.select("Label", F.explode(later).alias("_us"))
    spans = None if times is None else [(t - width, t) for t in times]
    counts = span_counts(
        labelled, reads.withColumn("_lo", F.col("_us") - width), ["Label"], spans, rows_per_chunk, tasks
    ).select("_us", "Label", F.col("_n").cast("double").alias("Count"))
    if long:
        return asked.join(counts, "_us").select(*polls.columns, "Label", "Count")
    packed = counts.groupBy("_us").agg(
        F.sort_array(F.collect_list(F.struct("Label", "Count"))).alias("Histogram")
    )
    empty = F.from_json(F.lit("[]"), "array<struct<Label:string,Count:double>>")
    return _with_result(polls, packed, poll_ts, "Histogram").select(
        *polls.columns, F.coalesce("Histogram", empty).alias("Histogram")
    )


def _later_polls(first: DataFrame, times: DataFrame, rows_per_chunk) -> DataFrame:
    """Every label with all poll times from its first message on. Polls are numbered, so that
    each label just lists its poll numbers and an equi-join gives the times."""
    span = 4_096
    both = first.select(
        F.col("_first").alias("_us"), F.lit(0).alias("_rank"), "Label"
    ).unionByName(
        times.select("_us", F.lit(1).alias("_rank"), F.lit(None).cast("string").alias("Label"))
    )
    # A label at a poll's time is seen by that poll, so labels come first.
    scan = ordered(both, ["_us", "_rank", "Label"], rows_per_chunk=rows_per_chunk).scan(
        _polls=("sum", F.col("_rank"))
    ).df
    numbered = scan.where("_rank = 1").select((F.col("_polls") - 1).alias("_poll"), "_us")
    end = F.lit(times.count() - 1)
    pieces = (
        scan.where((F.col("_rank") == 0) & (F.col("_polls") <= end))
        .select(
            "Label", F.col("_polls").alias("_from"),
            F.explode(F.sequence(F.floor(F.col("_polls") / span), F.floor(end / span)))
            .alias("_piece"),
        )
        .repartition("Label", "_piece")
    )
    return pieces.select(
        "Label",
        F.explode(
            F.sequence(
                F.greatest("_from", F.col("_piece") * span),
                F.least(end, F.col("_piece") * span + (span - 1)),
            )
        ).alias("_poll"),
    ).join(numbered, "_poll").select("Label", "_us")


def histogram_changes(
    events: DataFrame, polls: DataFrame, value: str, window: str, ts: str = "ts", id: str = "id",
    poll_ts: str = "ts", rows_per_chunk: int | None = None,
) -> DataFrame:
    """``polls`` with ``Label`` and ``Count``, but only where a label's live count is another than at the poll before (A2).

    A label's first row is that of the first poll that sees it, even if none of its messages is live any more. The full
    histogram of a poll has each label with its latest row up to then. A message changes the count at two polls at most, the
    first one not before it and the first one that no longer sees it, so there are at most two rows for each message, while
    ``histogram_at`` has one for each label and poll. The changes are summed by label and poll on the map side, and only
    those sums are put in order.
    """
    require_id(events, id)
    width = window_micros(window)
    kind = events.select(value).schema[0].dataType.simpleString()
    labelled = events.select(
        label_text(value, kind).alias("Label"), micros(ts).alias("_t"), F.col(id).alias("_id")
    ).where(F.col("Label").isNotNull() & F.col("_t").isNotNull())
    marks = labelled.select("Label", "_id", F.inline(F.array(
        F.struct(F.col("_t").alias("_us"), F.lit(1).alias("_delta")),
        F.struct((F.col("_t") + (width + 1)).alias("_us"), F.lit(-1).alias("_delta")),
    )))
    asked = polls.withColumn("_us", micros(poll_ts))
    distinct = asked.select("_us").where("_us IS NOT NULL").distinct()
    times = few_polls(asked.where("_us IS NOT NULL"), "_us")
    if times is not None:
        bounds = array_literal(times, "array<bigint>")
        # the number of polls before the mark is the place of the poll that sees it first
        seen = marks.where(F.col("_us") <= times[-1]) if times else marks.limit(0)
        placed = with_count_le(seen, "_poll", bounds, len(times), F.col("_us") - 1)
        at = F.get(bounds, F.col("_poll"))
        sums = placed.groupBy("Label", "_poll").agg(F.sum("_delta").alias("_delta"))
        sums = sums.select("Label", at.alias("_us"), "_delta")
    else:
        rows = marks.select("Label", "_delta", "_us", F.lit(0).alias("_rank"), "_id").unionByName(
            distinct.select("_us", F.lit(1).alias("_rank")), allowMissingColumns=True)
        scan = ordered(rows, ["_us", "_rank", "_id", "_delta"], rows_per_chunk=rows_per_chunk).scan(
            _polls=("sum", F.col("_rank"))).df
        numbered = scan.where("_rank = 1").select((F.col("_polls") - 1).alias("_poll"), F.col("_us").alias("_at"))
        sums = scan.where("_rank = 0").groupBy("Label", F.col("_polls").alias("_seen")).agg(F.sum("_delta").alias("_delta"))
        sums = lookup_join(sums, numbered, ["_seen"], ["_poll"], "inner").select("Label", F.col("_at").alias("_us"), "_delta")
    # a label's first change is the first poll that sees it
    counts = ordered(sums, ["_us"], ["Label"], rows_per_chunk).scan(_n=("sum", F.col("_delta")), _changes=("sum", F.lit(1))).df
    changes = counts.where((F.col("_delta") != 0) | (F.col("_changes") == 1)).select(
        "_us", "Label", F.col("_n").cast("double").alias("Count"))
    return asked.join(changes, "_us").select(*polls.columns, "Label", "Count")


def timeseries_at(
    events: DataFrame, polls: DataFrame, value: str | Column, n: int, ts: str = "ts",
    id: str = "id", poll_ts: str = "ts", pad: bool = True, rows_per_chunk: int | None = None,
) -> DataFrame:
    """``polls`` with ``timeseries``, the last ``n`` ``{timestamp, value}`` before each poll,
    oldest first (A4). Timestamps are epoch milliseconds.

    A value that is no number is recorded as 0. With ``pad`` the array always has ``n`` entries:
    the missing old ones are zeros, as in the reference.
    """
    if n < 1:
        raise ValueError("the number of samples must be positive")
    number = F.coalesce(as_col(value).try_cast("double"), F.lit(0.0))
    scan = _events_before(
        events.select(ts, require_id(events, id), number.alias("_value")), polls, n, ts, id,
        poll_ts, rows_per_chunk,
    )
    samples = scan.where("_rank = 0").select(
        (F.col("_before") - 1).alias("_idx"),
        F.floor(F.col("_us") / 1000).cast("double").alias("timestamp"),
        F.col("_m0._value").alias("value"),
    )
    reads = scan.where("_rank = 1").select("_us", "_before")
    wanted = (
        reads.select("_before").distinct().where("_before > 0")
        .select("_before", F.explode(F.sequence(
            F.greatest(F.col("_before") - n, F.lit(0)), F.col("_before") - 1)).alias("_idx"))
    )
    packed = wanted.join(samples, "_idx").groupBy(F.col("_before").alias("_of")).agg(
        F.sort_array(F.collect_list(F.struct("_idx", "timestamp", "value"))).alias("_last")
    )
    point = lambda t, v: F.struct(t.alias("timestamp"), v.alias("value"))
    found = F.coalesce(
        F.transform("_last", lambda s: point(s["timestamp"], s["value"])),
        F.from_json(F.lit("[]"), "array<struct<timestamp:double,value:double>>"),
    )
    zeros = F.array_repeat(point(F.lit(0.0), F.lit(0.0)), F.lit(n) - F.size(found))
    series = (F.concat(zeros, found) if pad else found).alias("timeseries")
    result = lookup_join(reads, packed, ["_before"], ["_of"]).select("_us", series)
    return _with_result(polls, result, poll_ts, "timeseries").select(*polls.columns, "timeseries")


def _recent(events, polls, n, ts, id, poll_ts, rows_per_chunk, **running) -> DataFrame:
    """Events (rank 0) and distinct poll times (rank 1) in arrival order, with running values.

    Only the last ``n`` events before each poll matter. With few polls and many events, no more than
    the last ``n`` between neighbouring polls are kept. That rank filter runs per map task before the
    shuffle, and what is left is known to be small.
    """
    asked = polls.select(F.col(poll_ts).alias("ts")).distinct()
    times = few_polls(asked.select(micros("ts").alias("_us")), "_us") if n <= RECENT_ROWS else None
    few = bool(times) and n * len(times) <= RECENT_ROWS
    small = few and events.count() >= 4 * n * len(times)
    if small:
        at = micros(ts)
        bounds = array_literal(times, "array<bigint>")
        latest = Window.partitionBy("_slot").orderBy(F.desc(ts), F.desc(id))
        events = (
            with_count_le(events.where(at <= times[-1]), "_slot", bounds, len(times), at - 1)
            .withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n)
            .drop("_slot", "_n")
        )
    rows, order = merged(Stream(events, ts, id), Stream(asked, "ts"))
    return ordered(rows, order, None, rows_per_chunk, bounded=small).scan(**running).df


def _events_before(events, polls, n, ts, id, poll_ts, rows_per_chunk) -> DataFrame:
    """Events and poll times with the number of (recent) events up to each row."""
    seen = ("sum", (F.col("_rank") == 0).cast("int"))
    return _recent(events, polls, n, ts, id, poll_ts, rows_per_chunk, _before=seen)


def last_n(df: DataFrame, n: int, ts: str = "ts", id: str = "id") -> DataFrame:
    """The last ``n`` messages, newest first. Every task keeps only its own last ``n``."""
    return df.orderBy(F.desc(ts), F.desc(require_id(df, id))).limit(n)


def dedupe(df: DataFrame, key: str, ts: str = "ts", id: str = "id") -> DataFrame:
    """The first message of every key (A5); rows without a key are skipped.

    The rank filter is applied per map task before the shuffle, so a key with very many rows
    sends one row per task.
    """
    if not isinstance(df.schema[key].dataType, T.StringType):
        raise ValueError("only text keys can be deduplicated")
    first = Window.partitionBy(key).orderBy(ts, require_id(df, id))
    return (
        df.where(F.col(key).isNotNull())
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") == 1)
        .drop("_n")
    )


def cardinality(adds: DataFrame, key: str, approx: bool = False) -> DataFrame:
    """Size of the set of added values (A6), exact or estimated."""
    size = F.approx_count_distinct(key) if approx else F.countDistinct(key)
    return adds.agg(size.cast("double").alias("cardinality"))


def cardinality_at(
    adds: DataFrame, polls: DataFrame, key: str, ts: str = "ts", poll_ts: str = "ts",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """``polls`` with the size of the set as of each poll: the keys first added by then."""
    first = adds.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(
        F.min(ts).alias("ts")
    )
    scan = arrival(
        Stream(first, "ts", "id"), Stream(polls, poll_ts), rows_per_chunk=rows_per_chunk
    ).scan(_keys=("sum", (F.col("_rank") == 0).cast("int"))).df
    return of_stream(scan, 1, F.col("_keys").cast("double").alias("cardinality"))


def cache_snapshot(
    puts: DataFrame, key: str, value: str, as_of: str | Column, ttl: str, ts: str = "ts",
    id: str = "id",
) -> DataFrame:
    """The live cache entries at one time, ``key`` and ``value``.

    The latest put of a key counts, and it is live while it is at most ``ttl`` old.
    """
    now = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    last = (
        puts.where((F.col(ts) <= now) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(
            F.max_by(F.struct(F.col(value).alias("value")), F.struct(ts, require_id(puts, id)))
            .alias("_put"),
            F.max(ts).alias("_at"),
        )
    )
    age = F.unix_micros(now) - F.unix_micros("_at")
    return last.where(age <= window_micros(ttl)).select("key", "_put.value")


def kl_divergence(p: DataFrame, q: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Kullback–Leibler divergence ``KL`` of two histograms in long form (A10).

    ``p`` and ``q`` have ``Label``, ``Count`` and the grouping columns ``by``; groups present on
    both sides are compared. A zero count is replaced by 0.0001 before normalising; a label that
    one side lacks gets 0.0001 after it, and that side is normalised again.

    With A = P/ΣP and B = Q/ΣQ (0.0001 where lacking), ZA = ΣA and ZB = ΣB, the divergence is
    Σ A·ln(A/B) / ZA + ln(ZB/ZA). Each sum needs only totals per group, so the labels of a group
    are added up with partial aggregation and never brought together.
    """
    by = list(by or [])
    count = lambda: F.when(F.col("Count") == 0, EPS).otherwise(F.col("Count").cast("double"))
    none = F.lit(None).cast("double")
    sides = p.select(*by, "Label", count().alias("_p"), none.alias("_q")).unionByName(
        q.select(*by, "Label", none.alias("_p"), count().alias("_q"))
    )
    labels = sides.groupBy(*by, "Label").agg(F.max("_p").alias("_p"), F.max("_q").alias("_q"))
    P, Q = F.col("_p"), F.col("_q")
    both, only_p, only_q = P.isNotNull() & Q.isNotNull(), Q.isNull(), P.isNull()
    part = lambda cond, col: F.coalesce(F.sum(F.when(cond, col)), F.lit(0.0))
    t = labels.groupBy(*by).agg(
        F.sum(P).alias("zp"), F.sum(Q).alias("zq"),
        part(both, P * F.log(P / Q)).alias("both_log"), part(both, P).alias("both_p"),
        part(only_p, P * F.log(P)).alias("p_log"), part(only_p, P).alias("p_p"),
        part(only_q, F.log(Q)).alias("q_log"), part(only_q, F.lit(1.0)).alias("q_n"),
        part(only_p, F.lit(1.0)).alias("p_n"),
    ).where(F.col("zp").isNotNull() & F.col("zq").isNotNull())
    c = {name: F.col(name) for name in t.columns}
    eps = F.lit(EPS)
    terms = (
        (c["both_log"] + (F.log(c["zq"]) - F.log(c["zp"])) * c["both_p"]) / c["zp"]
        + (c["p_log"] - (F.log(c["zp"]) + F.log(eps)) * c["p_p"]) / c["zp"]
        + eps * ((F.log(eps) + F.log(c["zq"])) * c["q_n"] - c["q_log"])
    )
    za, zb = F.lit(1.0) + eps * c["q_n"], F.lit(1.0) + eps * c["p_n"]
    return t.select(*by, (terms / za + F.log(zb / za)).alias("KL"))


def kl_divergence_arrays(df: DataFrame, p: str, q: str, id: str = "id") -> DataFrame:
    """``df`` with ``KL`` of two ``Histogram`` array columns, each row for itself. A row without
    both histograms is dropped. ``id`` is no longer needed."""
    none = F.lit(None).cast("double")

    def side(col: str, first: bool) -> Column:
        count = lambda x: F.when(x["Count"] == 0, EPS).otherwise(x["Count"].cast("double"))
        total = F.aggregate(F.transform(col, count), F.lit(0.0), lambda a, x: a + x)
        return F.flatten(F.transform(F.array(total), lambda z: F.transform(col, lambda x: F.struct(
            x["Label"].alias("Label"), (count(x) / z if first else none).alias("p"),
            (none if first else count(x) / z).alias("q"),
        ))))

    def divergence(cells: Column) -> Column:
        """Cells of one label lie side by side; each label counts at its first cell."""
        at = lambda i: F.get(cells, i)
        begins = lambda i: (i == 0) | ~at(i - 1)["Label"].eqNullSafe(at(i)["Label"])
        twin = lambda i, side: F.when(at(i + 1)["Label"].eqNullSafe(at(i)["Label"]), at(i + 1)[side])
        labels = F.transform(F.filter(F.sequence(F.lit(0), F.size(cells) - 1), begins), lambda i: F.struct(
            F.coalesce(at(i)["p"], twin(i, "p"), F.lit(EPS)).alias("a"),
            F.coalesce(at(i)["q"], twin(i, "q"), F.lit(EPS)).alias("b"),
        ))
        sums = F.aggregate(
            labels, F.struct(*[F.lit(0.0).alias(n) for n in ("t", "za", "zb")]),
            lambda s, x: F.struct((s["t"] + x["a"] * F.log(x["a"] / x["b"])).alias("t"),
                                  (s["za"] + x["a"]).alias("za"), (s["zb"] + x["b"]).alias("zb")),
            lambda s: s["t"] / s["za"] + F.log(s["zb"] / s["za"]),
        )
        return sums

    cells = F.array_sort(F.concat(side(p, True), side(q, False)))
    rows = df.where((F.size(p) > 0) & (F.size(q) > 0))
    return rows.withColumn("KL", F.element_at(F.transform(F.array(cells), divergence), 1))


def message_rate_at(
    events: DataFrame, polls: DataFrame, n: int = 100, ts: str = "ts", id: str = "id",
    poll_ts: str = "ts", rows_per_chunk: int | None = None,
) -> DataFrame:
    """``polls`` with ``Rate``, messages per second over the last ``n`` messages: their number
    divided by the time since the oldest of them; 0 before any message (A13)."""
    scan = _events_before(
        events.select(ts, require_id(events, id)), polls, n, ts, id, poll_ts, rows_per_chunk
    )
    oldest = scan.where("_rank = 0").select(
        (F.col("_before") - 1).alias("_of"), F.col("_us").alias("_oldest")
    )
    used = F.least(F.lit(n), F.col("_before"))
    reads = scan.where("_rank = 1").select("_us", "_before", (F.col("_before") - used).alias("_idx"))
    gap = F.col("_us") - F.col("_oldest")
    rate = (
        F.when(F.col("_before") == 0, 0.0)
        .when(gap == 0, float("inf"))
        .otherwise(F.try_divide(used * F.lit(1e6), gap))
    ).alias("Rate")
    result = lookup_join(reads, oldest, ["_idx"], ["_of"]).select("_us", rate)
    return _with_result(polls, result, poll_ts, "Rate").select(*polls.columns, "Rate")


def last_message(df: DataFrame, ts: str = "ts", id: str = "id") -> DataFrame:
    """The most recent message."""
    return last_n(df, 1, ts, id)


def last_message_at(
    events: DataFrame, polls: DataFrame, ts: str = "ts", id: str = "id", poll_ts: str = "ts",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """``polls`` with ``Last``, the most recent message (a struct) at each poll, or null."""
    require_id(events, id)
    result = _recent(events, polls, 1, ts, id, poll_ts, rows_per_chunk,
                     Last=("last", F.col("_m0")))
    result = result.where("_rank = 1").select("_us", "Last")
    return _with_result(polls, result, poll_ts, "Last").select(*polls.columns, "Last")


__all__ = [
    "cache_snapshot", "cardinality", "cardinality_at", "count_at", "dedupe", "histogram_at",
    "histogram_changes",
    "kl_divergence", "kl_divergence_arrays", "last_message", "last_message_at", "last_n",
    "message_rate_at", "moving_average_at", "rolling_average", "rolling_count", "timeseries_at",
]
