"""What the stateful processors ask of the state store: calls for each key and micro-batch, not for each row."""

import tracemalloc

import pandas as pd

from weir.streaming import controls, panes, stateful


class State:
    """A handle with states in memory that counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getValueState(self, *_):
        return Cell(self, None)

    def getListState(self, *_):
        return Cell(self, [])

    def getMapState(self, *_):
        return Cell(self, {})

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))


class Cell:
    def __init__(self, handle, empty):
        self.handle, self.empty, self.value = handle, empty, empty

    def counted(self):
        self.handle.calls += 1

    def get(self):
        self.counted()
        return self.value

    def update(self, value):
        self.counted()
        self.value = value

    put = update

    def appendList(self, values):
        self.update([*self.value, *values])

    def appendValue(self, value):
        self.appendList([value])

    def clear(self):
        self.update(self.empty)

    def getValue(self, k):
        self.counted()
        return self.value.get(k)

    def containsKey(self, k):
        return self.getValue(k) is not None

    def updateValue(self, k, v):
        self.update({**self.value, k: v})

    def removeKey(self, k):
        self.update({j: v for j, v in self.value.items() if j != k})

    def keys(self):
        return iter([*self.get()])

    def iterator(self):
        return iter([*self.get().items()])


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def rows(frames):
    return [tuple(r) for f in frames for r in f.itertuples(index=False)]


def started(processor):
    processor.init(State())
    return processor, processor.handle


def expire(processor, ms):
    """Timers as Spark fires them, one by one up to the watermark."""
    out, fired = [], 0
    for at in sorted(t for t in processor.handle.timers if t <= ms):
        processor.handle.timers.discard(at)
        made = Clock(at)
        out += rows(processor.handleExpiredTimer(("k",), Clock(ms), made))
        fired += 1
    return out, fired


def at(seconds):
    return pd.to_datetime([s * 1_000_000 for s in seconds], unit="us")


def test_sync_sends_all_due_messages_at_one_timer():
    sync, state = started(stateful._Sync())
    n = 300
    due = [(i + 10) * 1_000_000 for i in range(n)]
    frame = pd.DataFrame({"ts": at(range(n)), "rank": 0, "id": range(n), "own": range(n), "due": due, "message": "m"})
    assert rows(sync.handleInputRows(("k",), iter([frame]), None)) == []
    out, fired = expire(sync, 200_000)
    assert [r[3] for r in out] == list(range(191)) and fired == 1
    assert state.timers == {201_000} and state.calls < 10
    out, _ = expire(sync, 400_000)
    assert [r[3] for r in out] == list(range(191, n)) and not state.timers


def test_timeseries_reads_all_polls_at_one_timer():
    recent, state = started(panes._Recent(2, 1_000_000))
    n = 300
    frame = pd.DataFrame({"ts": at(range(n)), "id": range(n), "value": 1.0})
    assert rows(recent.handleInputRows(("k",), iter([frame]), None)) == []
    out, fired = expire(recent, 200_000)
    assert len(out) == 201 and fired == 1 and state.calls < 10
    out, _ = expire(recent, 400_000)
    assert len(out) == n - 201 and len(recent.kept.get()) == 2
    late = pd.DataFrame({"ts": at([500]), "id": [n], "value": 1.0})
    rows(recent.handleInputRows(("k",), iter([late]), None))
    out, _ = expire(recent, 600_000)
    assert len(out) == 1 and out[0][2].count("timestamp") == 2


def shard_rows(n, kind, message="m", control=None):
    """Messages of two keys, and a control message after every tenth."""
    text = lambda i: message if i % 10 else control
    return pd.DataFrame({
        "own": [f"k{i % 2}" if i % 10 else None for i in range(n)], "ts": at(range(n)), "rank": [kind(i) if i % 10 else 0 for i in range(n)],
        "id": [i if i % 10 else 0 for i in range(n)], "message": [text(i) for i in range(n)]})


def test_pairs_under_clears_take_few_calls():
    pairs, state = started(controls._ZipClear())
    out = rows(pairs.handleInputRows(("0",), iter([shard_rows(1000, lambda i: 1 + i // 2 % 2)]), None))
    assert len(out) == 400 and state.calls < 20
    assert pairs.epoch.value == (100,)


def test_packs_under_flushes_take_few_calls():
    packs, state = started(controls._PackFlush(3))
    frame = shard_rows(1000, lambda i: 2)
    frame["rank"] = frame["rank"].replace(0, 1)
    out = rows(packs.handleInputRows(("0",), iter([frame]), None))
    assert sum(len(r[2]) for r in out) == 900 - 3 and state.calls < 40


def test_shards_keep_texts_out_of_memory():
    def frames():
        for lo in range(0, 20_000, 1000):
            made = shard_rows(1000, lambda i: 1, "x" * 5000, "y" * 5000)
            yield made.assign(ts=made["ts"] + pd.Timedelta(lo, "s"), message=[t + str(i) for i, t in enumerate(made["message"])])

    pairs, _ = started(controls._ZipClear())
    tracemalloc.start()
    assert rows(pairs.handleInputRows(("0",), frames(), None)) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000  # of 100 million bytes of texts


def test_zip_keeps_what_waits_in_blocks():
    pairs, state = started(stateful._Zip())
    side = lambda n, rank, first: pd.DataFrame(
        {"ts": at(range(first, first + n)), "rank": rank, "id": range(n), "message": [f"{rank}-{i}" for i in range(n)]})
    assert rows(pairs.handleInputRows(("k",), iter([side(700, 0, 0)]), None)) == []
    assert state.calls < 10
    out = rows(pairs.handleInputRows(("k",), iter([side(600, 1, 700)]), None))
    assert [r[1:] for r in out] == [(i, f"0-{i}", f"1-{i}") for i in range(600)]
    assert len(pairs.waiting.value) == 1 and state.calls < 20
    out = rows(pairs.handleInputRows(("k",), iter([side(200, 1, 1300)]), None))
    assert [r[1:] for r in out] == [(i, f"0-{i}", f"1-{i - 600}") for i in range(600, 700)]
    assert sum(len(v[0]) > 2 for v in pairs.waiting.value.values()) == 2  # 100 wait on the other side


def test_a_session_takes_few_calls():
    packs, state = started(controls._SessionPack(10_000_000, 3))
    for first in range(0, 50, 5):
        frame = pd.DataFrame({"ts": at(range(first, first + 5)), "rank": 0, "id": range(5), "message": "m"})
        rows(packs.handleInputRows(("k",), iter([frame]), None))
    assert len(state.timers) == 1 and state.calls <= 21
    out, _ = expire(packs, 30_000)
    assert out == [] and state.timers == {59_001}
    out, _ = expire(packs, 59_001)
    assert [len(r[3]) for r in out] == [2] and packs.at.value is None
