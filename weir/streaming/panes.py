"""Polled averages, histograms and recent values on streams.

A poll looks back over many steps. So messages are first summed up per step (a pane), and a poll adds up panes: a message costs
one row, and only the panes, of which there are few, serve several polls. Both sums are Spark's own windowed aggregates,
the second one over the windows of the first.

Polls are the multiples of ``every``; both ends of the window count, as for the batch operators. The pane of poll q holds what came
after the poll before, up to q, and how much of it came at exactly q: of the pane at the window's lower end that alone is live.
Rows behind the watermark are dropped; ``delay`` says how far arrival times may be out of order between micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.duration import interval_micros, window_micros
from ..functions.expressions import as_col, label_text, micros
from .stateful import DELAY, _Blocks, _KeyState, _micros, _run


def _live(df: DataFrame, window: str, every: str, ts: str, by: list[str], sums: dict[str, Column], delay: str, before: bool) -> DataFrame:
    """``poll``, ``by`` and the sums of the live rows at each poll, and those at the poll before (``…_before``) if asked for."""
    width, step = window_micros(window), interval_micros(every)
    if width % step:
        raise ValueError("the window must be a whole number of polls")
    at_end = F.pmod(micros(ts), F.lit(step)) == 0
    # [q - step + 1, q + 1) in microseconds
    pane = F.window(ts, f"{step} microseconds", f"{step} microseconds", "1 microseconds")
    panes = df.withWatermark(ts, delay).groupBy(pane.alias("pane"), *by).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.sum(F.when(at_end, c)).alias(f"{n}_end") for n, c in sums.items()])
    reach = width + step * before
    polls = panes.select(
        F.window(F.window_time("pane"), f"{reach + step} microseconds", f"{step} microseconds", "1 microseconds").alias("span"),
        F.unix_micros(F.window_time("pane")).alias("at"), *by, *sums, *[f"{n}_end" for n in sums])

    def live(n: str, late: int) -> Column:
        poll = F.unix_micros("span.end") - 1 - late  # a span ends one microsecond after its poll
        inside = (F.col("at") > poll - width) & (F.col("at") <= poll)
        return F.sum(F.when(inside, F.col(n)).when(F.col("at") == poll - width, F.col(f"{n}_end")))

    names = [*sums, *([f"{n}_before" for n in sums] if before else [])]
    found = polls.groupBy("span", *by).agg(*[live(n.removesuffix("_before"), step * n.endswith("_before")).alias(n) for n in names])
    return found.select(F.timestamp_micros(F.unix_micros("span.end") - 1).alias("poll"), *by, *names)


def average_stream(
    df: DataFrame, value: str | Column, window: str, every: str, ts: str = "ts", by: list[str] | None = None, delay: str = "0 seconds",
) -> DataFrame:
    """``poll``, ``by``, ``Average`` of the numbers of the last ``window`` at every multiple of ``every`` (A3 on a stream).

    Values that are no numbers are skipped; polls without a live number give no row. The window is a whole number of polls.
    """
    number = as_col(value).try_cast("double")
    sums = {"_n": number.isNotNull().cast("bigint"), "_total": number}
    out = _live(df, window, every, ts, list(by or []), sums, delay, False)
    return out.where("_n > 0").select("poll", *(by or []), (F.col("_total") / F.col("_n")).alias("Average"))


def histogram_stream(
    df: DataFrame, value: str, window: str, every: str, ts: str = "ts", delay: str = "0 seconds",
) -> DataFrame:
    """``poll``, ``Label``, ``Count``: live messages per distinct value at every multiple of ``every`` (A2 on a stream).

    A label has rows while it is live, and one with Count 0 at the first poll at which it no longer is.
    """
    label = label_text(value, df.schema[value].dataType.simpleString())
    rows = df.select(ts, label.alias("Label")).where(F.col("Label").isNotNull())
    out = _live(rows, window, every, ts, ["Label"], {"_n": F.lit(1).cast("bigint")}, delay, True)
    return out.where("_n > 0 OR _n_before > 0").select("poll", "Label", F.coalesce("_n", F.lit(0)).cast("double").alias("Count"))


class _Recent(_KeyState):
    """The last messages of a key, read at the polls that follow new ones."""

    columns = ["poll", "timeseries"]

    def __init__(self, n: int, step: int):
        self.n, self.step = n, step

    def open(self, handle):
        self.kept = _Blocks(handle, "kept")  # microseconds, id, value
        self.done = handle.getValueState("done", "poll bigint")

    def poll(self, us: int) -> int:
        return -(-us // self.step) * self.step

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            us = _micros(batch["ts"]).tolist()
            self.kept.add(list(zip(us, batch["id"].tolist(), batch["value"].tolist())))
            first = min(us) if first is None else min(first, min(us))
        # One timer for the earliest poll reads all polls that the watermark has passed.
        self.handle.registerTimer(self.poll(first) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        done = self.done.get()
        rows = sorted(self.kept.get())
        # Of the rows at or before the last poll read only the last n are kept; they ask for no poll.
        waiting = sorted({self.poll(r[0]) for r in rows if done is None or r[0] > done[0]})
        polls = [p for p in waiting if p <= passed]
        if not polls:
            return
        out, seen = [], 0
        for p in polls:
            while seen < len(rows) and rows[seen][0] <= p:
                seen += 1
            last = rows[max(seen - self.n, 0):seen]
            series = json.dumps([{"timestamp": float(u // 1000), "value": v} for u, _, v in last])
            out.append((key[0], p, series))
        self.kept.put(rows[max(seen - self.n, 0):])
        self.done.update((polls[-1],))
        if len(waiting) > len(polls):
            self.handle.registerTimer(waiting[len(polls)] // 1000)
        made = pd.DataFrame(out, columns=["key", *self.columns])
        yield made.assign(poll=pd.to_datetime(made["poll"], unit="us"))


def timeseries_stream(
    df: DataFrame, key: str, value: str | Column, n: int, every: str, ts: str = "ts", id: str = "id", delay: str = DELAY,
) -> DataFrame:
    """``key``, ``poll``, ``timeseries``: the last ``n`` values of a key at the polls that see new ones (A4 on a stream).

    Polls are the multiples of ``every``, whole milliseconds. A value that is no number is recorded as 0. The state of a key
    holds n values and those of polls that are not over; a poll is read when the watermark has passed it.
    """
    step = interval_micros(every)
    if step % 1000:
        raise ValueError("polls must be whole milliseconds apart")
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(id).cast("bigint").alias("id"),
        F.coalesce(as_col(value).try_cast("double"), F.lit(0.0)).alias("value"),
    ).withWatermark("ts", delay)
    out = _run(rows, _Recent(n, step), "key string, poll timestamp, timeseries string", "EventTime")
    return out.select("key", "poll", F.from_json("timeseries", "array<struct<timestamp:double,value:double>>").alias("timeseries"))
