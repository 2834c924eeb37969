"""Order-dependent operators on streams, as state per key.

Spark keeps the state per key and in a fault-tolerant store; the processors below only say what one key
does with its next rows. They need the RocksDB state store (``use_rocksdb``). The rows of a key
are taken micro-batch by micro-batch, in ``(ts, rank, id)`` order within each. Messages travel as JSON
text in the column ``message``, so any schema will do.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.duration import parse_duration, window_micros
from ..functions.expressions import MICROS

# Spark drops rows at or behind the watermark, so it must stay behind the latest arrival for rows of
# the same instant that come with the next micro-batch.
DELAY = "1 millisecond"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Waiting messages of a key that share one value of the state.
BLOCK = 256


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _rows(df: DataFrame, key: str, ts: str, id: str, rank: int = 0) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.lit(rank).alias("rank"),
        F.col(id).cast("bigint").alias("id"), F.to_json(F.struct("*"), MICROS).alias("message"),
    )


def _run(df: DataFrame, processor: StatefulProcessor, schema: str, mode: str = "None") -> DataFrame:
    use_rocksdb(df.sparkSession)
    return df.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode
    )


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["ts", "rank", "id"], kind="stable")


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("int64") // (1000 if ts.dtype == "datetime64[ns]" else 1)


class _KeyState(StatefulProcessor):
    """Common shape: subclasses turn one key's ordered rows into output rows."""

    columns: list[str] = []

    def init(self, handle) -> None:
        self.handle = handle
        self.open(handle)

    def open(self, handle) -> None:
        raise NotImplementedError

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = [(key[0], *made) for made in self.step(_in_order(rows))]
        yield pd.DataFrame(out, columns=["key", *self.columns])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([], columns=["key", *self.columns])

    def close(self) -> None:
        pass


class _Blocks:
    """Rows of a key in the state, as one JSON text for each micro-batch: a call and a value for many rows."""

    def __init__(self, handle, name: str):
        self.state = handle.getListState(name, "block string")

    def add(self, rows: list[tuple]) -> None:
        if rows:
            self.state.appendValue((json.dumps(rows),))

    def get(self) -> list[tuple]:
        return [tuple(r) for block in self.state.get() for r in json.loads(block[0])]

    def put(self, rows: list[tuple]) -> None:
        if rows:
            self.state.put([(json.dumps(rows),)])
        else:
            self.state.clear()


def _get(state, default):
    value = state.get()
    return default if value is None else value


class _Toggle(_KeyState):
    columns = ["id", "state"]

    def open(self, handle):
        self.seen = handle.getValueState("seen", "n bigint")

    def step(self, rows):
        n = _get(self.seen, (0,))[0]
        self.seen.update((n + len(rows),))
        return [(i, (n + at) % 2 == 0) for at, i in enumerate(rows["id"])]


def toggle_stream(df: DataFrame, key: str, ts: str = "ts", id: str = "id") -> DataFrame:
    """``key``, ``id``, ``state``: true for the first message of a key, flipped by each next."""
    return _run(_rows(df, key, ts, id), _Toggle(), "key string, id bigint, state boolean")


class _PackByCount(_KeyState):
    columns = ["number", "Pack"]

    def __init__(self, n: int):
        self.n = n

    def open(self, handle):
        self.waiting = handle.getListState("waiting", "message string")
        self.sent = handle.getValueState("sent", "n bigint")

    def step(self, rows):
        batch = [m[0] for m in self.waiting.get()]
        number, out = _get(self.sent, (0,))[0], []
        for message in rows["message"]:
            if len(batch) == self.n:
                out.append((number, batch))
                batch, number = [], number + 1
            batch.append(message)
        self.waiting.put([(m,) for m in batch])
        self.sent.update((number,))
        return out


def pack_by_count_stream(
    df: DataFrame, key: str, n: int, ts: str = "ts", id: str = "id"
) -> DataFrame:
    """``key``, ``number``, ``Pack``: packs of ``n`` messages per key, each sent when the next message
    of the key arrives."""
    if n < 1:
        raise ValueError("the pack size must be positive")
    return _run(_rows(df, key, ts, id), _PackByCount(n),
                "key string, number bigint, Pack array<string>")


class _Queue(_KeyState):
    columns = ["pop", "message"]

    def open(self, handle):
        self.ends = handle.getValueState("ends", "head bigint, tail bigint")
        self.stored = handle.getMapState("stored", "k bigint", "message string")

    def step(self, rows):
        head, tail = _get(self.ends, (0, 0))
        fresh, out = deque(), []  # messages of this micro-batch that are not in the store
        fresh_from = tail
        for rank, i, message in zip(rows["rank"], rows["id"], rows["message"]):
            if rank == 0:
                fresh.append(message)
                tail += 1
            elif head < tail:
                if head < fresh_from:
                    out.append((i, self.stored.getValue((head,))[0]))
                    self.stored.removeKey((head,))
                else:
                    out.append((i, fresh.popleft()))
                head += 1
        for at, message in enumerate(fresh, tail - len(fresh)):
            self.stored.updateValue((at,), (message,))
        self.ends.update((head, tail))
        return out


def queue_stream(
    pushes: DataFrame, pops: DataFrame, key: str, ts: str = "ts", id: str = "id"
) -> DataFrame:
    """FIFO queue per key: ``key``, ``pop`` (its id), ``message``, for every pop that is served."""
    both = _rows(pushes, key, ts, id).unionByName(_rows(pops, key, ts, id, 1))
    return _run(both, _Queue(), "key string, pop bigint, message string")


class _Zip(_KeyState):
    columns = ["idx", "A", "B"]

    def open(self, handle):
        self.seen = handle.getValueState("seen", "a bigint, b bigint")
        self.waiting = handle.getMapState("waiting", "block bigint", "messages string")

    def step(self, rows):
        seen, out = list(_get(self.seen, (0, 0))), []
        blocks: dict[int, dict[str, str]] = {}  # of BLOCK indexes each, as the state holds them
        stored = set()

        def block(idx: int) -> dict[str, str]:
            at = idx // BLOCK
            if at not in blocks:
                had = self.waiting.getValue((at,))
                blocks[at] = {} if had is None else json.loads(had[0])
                stored.update([at] if had is not None else [])
            return blocks[at]

        for side, message in zip(rows["rank"].tolist(), rows["message"].tolist()):
            idx = seen[side]
            seen[side] += 1
            if seen[1 - side] <= idx:
                block(idx)[str(idx)] = message
                continue
            other = block(idx).pop(str(idx))
            out.append((idx, message, other) if side == 0 else (idx, other, message))
        for at, messages in blocks.items():
            if messages:
                self.waiting.updateValue((at,), (json.dumps(messages),))
            elif at in stored:
                self.waiting.removeKey((at,))
        self.seen.update(tuple(seen))
        return out


def zip_stream(a: DataFrame, b: DataFrame, key: str, ts: str = "ts", id: str = "id") -> DataFrame:
    """Pair the i-th message of both streams per key: ``key``, ``idx``, ``A``, ``B``."""
    both = _rows(a, key, ts, id).unionByName(_rows(b, key, ts, id, 1))
    return _run(both, _Zip(), "key string, idx bigint, A string, B string")


class _Cache(_KeyState):
    columns = ["id", "value"]

    def __init__(self, ttl_us: int):
        self.ttl = pd.Timedelta(ttl_us, "us")

    def open(self, handle):
        self.entry = handle.getValueState("entry", "at timestamp, value string")

    def step(self, rows):
        at, value = _get(self.entry, (None, None))
        at = None if at is None else pd.Timestamp(at)
        changed, out = False, []
        for rank, ts, i, put in zip(rows["rank"], rows["ts"], rows["id"], rows["value"]):
            if rank == 0:
                at, value, changed = ts, put, True
            else:
                out.append((i, value if at is not None and ts - at <= self.ttl else None))
        if changed:
            self.entry.update((at.to_pydatetime(), value))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            # Timers count whole milliseconds; the entry is kept until it is surely expired.
            self.handle.registerTimer(int((at + self.ttl).timestamp() * 1000) + 1)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.entry.clear()
        yield pd.DataFrame([], columns=["key", *self.columns])


def cache_lookup_stream(
    lookups: DataFrame, puts: DataFrame, key: str, value: str, ttl: str, ts: str = "ts",
    id: str = "id", delay: str = DELAY,
) -> DataFrame:
    """``key``, ``id`` of the lookup, ``value`` (as text): the latest put at most ``ttl`` old.

    Expired entries are removed from the state by a timer. ``delay`` says how far ``ts`` may be out of
    order between micro-batches; rows further behind are dropped.
    """
    values = puts.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.lit(0).alias("rank"),
        F.col(id).cast("bigint").alias("id"), F.col(value).cast("string").alias("value"),
    )
    asks = _rows(lookups, key, ts, id, 1).drop("message").withColumn(
        "value", F.lit(None).cast("string")
    )
    both = values.unionByName(asks, allowMissingColumns=True).withWatermark("ts", delay)
    return _run(both, _Cache(window_micros(ttl)), "key string, id bigint, value string",
                "EventTime")


class _Sync(_KeyState):
    """One timer a key and micro-batch, for the earliest release: it sends all that the watermark has passed."""

    columns = ["release", "late", "id", "message"]

    def open(self, handle):
        self.held = _Blocks(handle, "held")  # due, own time, id, message

    def wait(self, held: list[tuple]) -> None:
        if held:
            self.handle.registerTimer(-(-min(r[0] for r in held) // 1000))

    def handleInputRows(self, key, rows, timerValues):
        ordered = _in_order(rows)
        late = ordered["due"] < _micros(ordered["ts"])
        on_time, behind = ordered[~late], ordered[late]
        held = list(zip(*[on_time[c].tolist() for c in ("due", "own", "id", "message")]))
        self.held.add(held)
        self.wait(held)
        if len(behind):
            yield pd.DataFrame({
                "key": key[0], "release": behind["ts"], "late": True, "id": behind["id"], "message": behind["message"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        ready, later = [], []
        for r in self.held.get():
            (ready if r[0] <= passed else later).append(r)
        if not ready:
            return
        self.held.put(later)
        self.wait(later)
        ready.sort(key=lambda r: r[:3])
        due, _, ids, messages = zip(*ready)
        yield pd.DataFrame({
            "key": key[0], "release": pd.to_datetime(list(due), unit="us"), "late": False, "id": ids, "message": messages})


def sync_stream(
    df: DataFrame, key: str, time_ms: str, lag: str, ts: str = "ts", id: str = "id",
    delay: str = DELAY,
) -> DataFrame:
    """Messages per key in the order of their own time, released ``lag`` later: ``key``, ``release``,
    ``late``, ``id``, ``message``.

    The clock is the watermark of the arrival time. A message whose release time has passed on
    arrival is sent at once with ``late``. ``delay`` says how far arrival times may be out of order
    between micro-batches; within it none is dropped. What is not yet due at the end of the input
    stays in the state.
    """
    own = F.round(F.col(time_ms).try_cast("double") * 1000).cast("bigint")
    rows = df.where(F.col(key).isNotNull() & own.isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.lit(0).alias("rank"),
        F.col(id).cast("bigint").alias("id"), own.alias("own"),
        (own + parse_duration(lag)).alias("due"), F.to_json(F.struct("*"), MICROS).alias("message"),
    )
    schema = "key string, release timestamp, late boolean, id bigint, message string"
    return _run(rows.withWatermark("ts", delay), _Sync(), schema, "EventTime")
