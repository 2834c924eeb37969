"""Step-by-step simulations of the stateful operators, and random streams to compare on.

Times are whole seconds; a small range makes many ties. At equal time the rank decides, as in the
operators.
"""

from __future__ import annotations

import datetime as dt
import random
from collections import deque

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(sec: float) -> dt.datetime:
    return BASE + dt.timedelta(seconds=sec)


def sec(t: dt.datetime) -> int:
    if t.tzinfo is None:
        t = t.replace(tzinfo=dt.timezone.utc)
    return round((t - BASE).total_seconds())


def stream(seed: int, n: int, span: int, keys: int = 3, hot: float = 0.4) -> list[dict]:
    """``n`` messages over ``span`` seconds; ``hot`` of them at one instant and with one key."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        is_hot = rng.random() < hot
        out.append(
            {
                "id": i,
                "t": span // 2 if is_hot else rng.randrange(span),
                "key": "k0" if is_hot or rng.random() < 0.3 else f"k{rng.randrange(keys)}",
                "value": float(rng.randrange(1000)) / 4,
            }
        )
    return out


def frame(spark, rows: list[dict]):
    data = [(r["id"], at(r["t"]), r["key"], r["value"]) for r in rows]
    return spark.createDataFrame(data, "id long, ts timestamp, key string, value double")


def times(spark, secs: list[int]):
    return spark.createDataFrame([(at(s),) for s in secs], "ts timestamp")


def ordered(*streams: list[dict] | list[int]) -> list[tuple[int, int, dict]]:
    """(time, rank, row) of several streams in arrival order."""
    out = []
    for rank, rows in enumerate(streams):
        for i, r in enumerate(rows):
            r = {"t": r, "id": i} if isinstance(r, int) else r
            out.append((r["t"], rank, r["id"], r))
    out.sort(key=lambda x: x[:3])
    return [(t, rank, r) for t, rank, _, r in out]


def live(events, polls, window, clears=()):
    """Per poll the live messages."""
    state, out = [], {}
    for t, rank, r in ordered(list(clears), events, list(polls)):
        if rank == 0:
            state = []
        elif rank == 1:
            state.append(r)
        else:
            out[t] = [m for m in state if t - window <= m["t"]]
    return out


def zipped(a, b, clears=()):
    qa, qb, out = deque(), deque(), []
    for _, rank, r in ordered(list(clears), a, b):
        if rank == 0:
            qa.clear(), qb.clear()
        else:
            (qa if rank == 1 else qb).append(r["id"])
        if qa and qb:
            out.append((qa.popleft(), qb.popleft()))
    return out


def in_batches(rows, size, side):
    """Arrival order of two streams that come in micro-batches: ``side`` gives a row's stream."""
    out = []
    for i in range(0, len(rows), size):
        part = rows[i:i + size]
        out += ordered([r for r in part if side(r) == 0], [r for r in part if side(r) == 1])
    return out


def popped(pushes, pops, polls=(), arrived=None):
    q, out, peeks = deque(), [], {}
    for t, rank, r in arrived or ordered(pushes, pops, list(polls)):
        if rank == 0:
            q.append(r["id"])
        elif rank == 1:
            if q:
                out.append((r["id"], q.popleft()))
        else:
            peeks[t] = q[0] if q else None
    return out, peeks


def looked_up(puts, lookups, ttl, arrived=None):
    cache, out = {}, {}
    for t, rank, r in arrived or ordered(puts, lookups):
        if rank == 0:
            cache[r["key"]] = (t, r["value"])
        else:
            hit = cache.get(r["key"])
            out[r["id"]] = hit[1] if hit and t - hit[0] <= ttl else None
    return out


def packed(rows, n, clears=(), flushes=()):
    batch, out = [], []
    for _, rank, r in ordered(list(clears), list(flushes), rows):
        if rank == 0:
            batch = []
        elif rank == 1:
            out.append(list(batch))
            batch = []
        else:
            if len(batch) == n:
                out.append(batch)
                batch = []
            batch = batch + [r["id"]]
    return out, batch


def sessions(rows, gap):
    open_, out = {}, []
    for t, _, r in ordered(rows):
        k = r["key"]
        if k in open_ and t - open_[k][0] > gap:
            out.append((k, open_.pop(k)[1]))
        last = open_.get(k, (t, []))
        open_[k] = (t, last[1] + [r["id"]])
    return out + [(k, v[1]) for k, v in open_.items()]
