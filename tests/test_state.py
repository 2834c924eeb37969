"""The stateful operators against step-by-step simulations, on streams in which one instant and
one key hold a large share, with chunks so small that every code path runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import sims
import weir

CHUNK_SIZES = [None, 40]


@pytest.fixture(params=CHUNK_SIZES, ids=["whole", "chunks"])
def chunk(request):
    return request.param


@pytest.fixture(params=[True, False], ids=["slots", "rows"])
def many_polls(request, monkeypatch):
    """Also run with the row limit for few polls at zero."""
    if not request.param:
        import weir.plans.trailing as trailing

        monkeypatch.setattr(trailing, "MAX_SLOT_POLLS", 0)
    return request.param


EVENTS = sims.stream(1, 300, 200)
POLLS = list(range(-5, 230, 7)) + [100]


@pytest.mark.parametrize("window", [0, 10, 1000])
def test_count_at(spark, chunk, many_polls, window):
    want = {t: float(len(m)) for t, m in sims.live(EVENTS, POLLS, window).items()}
    got = weir.count_at(sims.frame(spark, EVENTS), sims.times(spark, POLLS), f"{window}s",
                        rows_per_chunk=chunk)
    assert {sims.sec(r.ts): r.Count for r in got.collect()} == want


def test_count_at_with_clears(spark, chunk, many_polls):
    clears = [50, 99, 100, 101, 150]
    want = {t: float(len(m)) for t, m in sims.live(EVENTS, POLLS, 40, clears).items()}
    got = weir.count_at(sims.frame(spark, EVENTS), sims.times(spark, POLLS), "40s",
                        clears=sims.times(spark, clears), rows_per_chunk=chunk)
    assert {sims.sec(r.ts): r.Count for r in got.collect()} == want


def test_rolling(spark, chunk):
    df = sims.frame(spark, EVENTS)
    window = 12
    want = {
        e["id"]: [m["value"] for m in EVENTS if e["t"] - window <= m["t"] <= e["t"]]
        for e in EVENTS
    }
    got = weir.rolling_count(df, "12s", rows_per_chunk=chunk).collect()
    assert {r.id: r.Count for r in got} == {i: float(len(v)) for i, v in want.items()}
    got = weir.rolling_average(df, "value", "12s", rows_per_chunk=chunk).collect()
    assert {r.id: r.Average for r in got} == {
        i: pytest.approx(sum(v) / len(v)) for i, v in want.items()
    }


def test_rolling_edges(spark):
    """Rows without a time or a value, a long window, one hot instant, other columns of any kind."""
    rows = [(i, sims.at(i % 50 if i % 3 else 25), None if i % 7 == 0 else i / 2, {"a": [i]}) for i in range(300)] + [(300, None, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, value double, more map<string, array<int>>")
    for width in (0, 3, 1000):
        for chunk in (20, None):
            got = {r.id: r for r in weir.rolling_average(df, "value", f"{width}s", rows_per_chunk=chunk).collect()}
            counts = {r.id: r.Count for r in weir.rolling_count(df, f"{width}s", rows_per_chunk=chunk).collect()}
            assert got[300].Average is None and counts[300] == 0 and len(got) == len(counts) == 301
            for i, t, _, more in rows[:300]:
                live = [v for _, u, v, _ in rows[:300] if sims.sec(t) - width <= sims.sec(u) <= sims.sec(t)]
                values = [v for v in live if v is not None]
                assert counts[i] == len(live) and got[i].more == more
                assert got[i].Average == (pytest.approx(sum(values) / len(values)) if values else None)
    assert weir.rolling_count(df.limit(0), "1s").count() == 0
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        there = df.withColumn("more", F.struct("ts"))
        assert weir.rolling_count(there, "3s", rows_per_chunk=20).where("ts = more.ts AND Count > 0").count() == 300
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_learn_at(spark, chunk, many_polls):
    """Least squares of all messages up to each poll, with two features and the constant."""
    rng = np.random.default_rng(4)
    rows = [(i, sims.at(int(rng.integers(60))), *map(float, rng.normal(size=3))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, a double, b double, y double")
    extra = df.limit(3).withColumn("a", F.lit(None).cast("double")).withColumn("id", F.col("id") + 1000)
    polls = [0, 1, 7, 30, 59, 90]
    got = weir.learn_at(df.union(extra), sims.times(spark, polls), ["a", "b", F.lit(1.0)], "y", rows_per_chunk=chunk)
    found = {sims.sec(r.ts): r.params for r in got.collect()}
    for p in polls:
        live = [r for r in rows if sims.sec(r[1]) <= p]
        if len(live) < 3:
            assert found[p] is None
            continue
        x = np.array([[r[2], r[3], 1.0] for r in live])
        want = np.linalg.lstsq(x, np.array([r[4] for r in live]), rcond=None)[0]
        assert found[p] == pytest.approx(list(want), abs=1e-6)
    same = weir.learn_at(df, sims.times(spark, polls), ["a", F.col("a") * 2], "y", rows_per_chunk=chunk)
    assert all(r.params is None for r in same.collect())


def test_moving_average_skips_non_numbers(spark, chunk, many_polls):
    want = {
        t: pytest.approx(sum(m["value"] for m in ms) / len(ms)) if ms else None
        for t, ms in sims.live(EVENTS, POLLS, 15).items()
    }
    text = sims.frame(spark, EVENTS).withColumn("value", F.col("value").cast("string"))
    extra = text.limit(5).withColumns({"value": F.lit("no number"), "id": F.col("id") + 10_000})
    got = weir.moving_average_at(text.union(extra), sims.times(spark, POLLS), "value", "15s",
                                 rows_per_chunk=chunk)
    assert {sims.sec(r.ts): r.Average for r in got.collect()} == want


def test_histogram_at(spark, chunk, many_polls):
    state = sims.live(EVENTS, POLLS, 20)
    first = {}
    for e in EVENTS:
        first[e["key"]] = min(first.get(e["key"], e["t"]), e["t"])
    want = {
        t: sorted(
            (k, float(sum(m["key"] == k for m in ms))) for k, f in first.items() if f <= t
        )
        for t, ms in state.items()
    }
    df, polls = sims.frame(spark, EVENTS), sims.times(spark, POLLS)
    got = weir.histogram_at(df, polls, "key", "20s", rows_per_chunk=chunk).collect()
    assert {sims.sec(r.ts): [tuple(b) for b in r.Histogram] for r in got} == want
    got = weir.histogram_at(df, polls, "key", "20s", long=True, rows_per_chunk=chunk).collect()
    assert {(sims.sec(r.ts), r.Label, r.Count) for r in got} == {
        (t, k, c) for t, rows in want.items() for k, c in rows
    }


def test_histogram_changes(spark, chunk, many_polls):
    """Carried forward, the changes are the full histogram; there are at most two of them for each message."""
    df, polls = sims.frame(spark, EVENTS), sims.times(spark, sorted(set(POLLS)))
    for window in (3, 1000):
        full = {(sims.sec(r.ts), r.Label): r.Count for r in weir.histogram_at(
            df, polls, "key", f"{window}s", long=True, rows_per_chunk=chunk).collect()}
        rows = weir.histogram_changes(df, polls, "key", f"{window}s", rows_per_chunk=chunk).collect()
        changes = {(sims.sec(r.ts), r.Label): r.Count for r in rows}
        assert len(changes) == len(rows) <= 2 * len(EVENTS)
        now, want = {}, {}
        for p in sorted(set(POLLS)):
            before = dict(now)
            now |= {k: c for (t, k), c in changes.items() if t == p}
            assert all(before.get(k) != now[k] for t, k in changes if t == p)
            want |= {(p, k): c for k, c in now.items()}
        assert want == full
    assert weir.histogram_changes(df, polls.limit(0), "key", "1s").count() == 0


@pytest.mark.parametrize("pad", [True, False])
def test_timeseries_rate_and_last(spark, chunk, pad):
    df, polls = sims.frame(spark, EVENTS), sims.times(spark, POLLS)
    state = sims.live(EVENTS, POLLS, 10**6)
    got = weir.timeseries_at(df, polls, "value", 4, pad=pad, rows_per_chunk=chunk).collect()
    for r in got:
        last = state[sims.sec(r.ts)][-4:]
        want = [(sims.at(m["t"]).timestamp() * 1000, m["value"]) for m in last]
        zeros = [(0.0, 0.0)] * (4 - len(want)) if pad else []
        assert [tuple(p) for p in r.timeseries] == zeros + want
    got = weir.last_message_at(df, polls, rows_per_chunk=chunk).collect()
    assert {sims.sec(r.ts): r.Last and r.Last.id for r in got} == {
        t: ms[-1]["id"] if ms else None for t, ms in state.items()
    }
    got = weir.message_rate_at(df, polls, 9, rows_per_chunk=chunk).collect()
    for r in got:
        t = sims.sec(r.ts)
        last = state[t][-9:]
        gap = t - last[0]["t"] if last else 0
        want = 0.0 if not last else float("inf") if gap == 0 else len(last) / gap
        assert r.Rate == pytest.approx(want)


def test_cardinality_at(spark, chunk):
    got = weir.cardinality_at(sims.frame(spark, EVENTS), sims.times(spark, POLLS), "key",
                              rows_per_chunk=chunk).collect()
    assert {sims.sec(r.ts): r.cardinality for r in got} == {
        t: float(len({m["key"] for m in ms}))
        for t, ms in sims.live(EVENTS, POLLS, 10**6).items()
    }


@pytest.mark.parametrize("clears", [[], [30, 100, 101, 160]])
def test_zip_join(spark, chunk, clears):
    a, b = sims.stream(2, 150, 200), sims.stream(3, 170, 200)
    got = weir.zip_join(sims.frame(spark, a), sims.frame(spark, b),
                        clears=sims.times(spark, clears) if clears else None,
                        rows_per_chunk=chunk)
    pairs = [(r.A.id, r.B.id) for r in got.collect()]
    assert sorted(pairs) == sorted(sims.zipped(a, b, clears))


@pytest.mark.parametrize("seed", [4, 5])
def test_queue(spark, chunk, seed):
    pushes, pops = sims.stream(seed, 120, 200), sims.stream(seed + 10, 130, 200)
    want, peeks = sims.popped(pushes, pops, POLLS)
    dfs = sims.frame(spark, pushes), sims.frame(spark, pops)
    got = weir.queue_pops(*dfs, rows_per_chunk=chunk).orderBy("k").collect()
    assert [(r.pop.id, r.message.id) for r in got] == want
    assert [r.k for r in got] == list(range(len(want)))
    got = weir.queue_peek(*dfs, sims.times(spark, POLLS), rows_per_chunk=chunk).collect()
    assert {sims.sec(r.ts): r.message and r.message.id for r in got} == peeks


def test_cache_lookup(spark, chunk):
    puts, lookups = sims.stream(6, 200, 200), sims.stream(7, 210, 200, keys=5)
    got = weir.cache_lookup(sims.frame(spark, lookups).drop("value"), sims.frame(spark, puts),
                            "key", "value", "10s", rows_per_chunk=chunk).collect()
    assert {r.id: r.value for r in got} == sims.looked_up(puts, lookups, 10)


@pytest.mark.parametrize("n", [1, 4])
@pytest.mark.parametrize("markers", [False, True])
def test_pack_by_count(spark, chunk, n, markers):
    rows = sims.stream(8, 120, 200)
    clears = [20, 99, 100, 120] if markers else []
    flushes = [10, 60, 61, 100, 130, 195] if markers else []
    want, open_ = sims.packed(rows, n, clears, flushes)
    args = {"clears": sims.times(spark, clears), "flushes": sims.times(spark, flushes)}
    df = sims.frame(spark, rows)
    for tail in (False, True):
        got = weir.pack_by_count(df, n, flush_tail=tail, rows_per_chunk=chunk,
                                 **(args if markers else {})).collect()
        got.sort(key=lambda r: (r.epoch, r.number))
        packs = [[m.id for m in r.Pack or []] for r in got]
        assert packs == want + ([open_] if tail and open_ else [])


def test_pack_by_count_of_zero_collects_nothing(spark):
    assert weir.pack_by_count(sims.frame(spark, EVENTS), 0, flush_tail=True).count() == 0


def test_sessions(spark, chunk):
    rows = sims.stream(9, 150, 400)
    df = sims.frame(spark, rows)
    want = sorted((k, sorted(ids)) for k, ids in sims.sessions(rows, 6))
    got = weir.pack_by_value(df, "key", "6s", rows_per_chunk=chunk).collect()
    assert sorted((r.key, sorted(m.id for m in r.Pack)) for r in got) == want
    for r in got:
        order = [(m.ts, m.id) for m in r.Pack]
        assert order == sorted(order)
    small = weir.pack_by_value(df, "key", "6s", pack_rows=10, rows_per_chunk=chunk).collect()
    joined = {}
    for r in sorted(small, key=lambda r: r.Part):
        joined.setdefault((r.key, r.session), []).extend(m.id for m in r.Pack)
    whole = {(r.key, r.session): [m.id for m in r.Pack] for r in got}
    assert joined == whole and len(small) > len(got)
    summary = weir.session_summary(df, "key", "6s", rows_per_chunk=chunk).collect()
    assert sorted((r.key, r.Count) for r in summary) == sorted(
        (k, float(len(i))) for k, i in want
    )
    closed = weir.session_summary(df, "key", "6s", as_of=F.lit(sims.at(300))).collect()
    assert len(closed) == sum(
        max(rows[i]["t"] for i in ids) + 6 < 300 for _, ids in want
    )


def test_session_gap_is_inclusive(spark):
    rows = [{"id": i, "t": t, "key": "a", "value": 0.0} for i, t in enumerate([0, 4, 8, 13])]
    got = weir.session_summary(sims.frame(spark, rows), "key", "4s").collect()
    assert sorted(r.Count for r in got) == [1.0, 3.0]


def test_toggle_and_every_nth(spark, chunk):
    rows = [r for _, _, r in sims.ordered(EVENTS)]
    got = weir.toggle(sims.frame(spark, EVENTS), rows_per_chunk=chunk).collect()
    assert {r.id: r.state for r in got} == {r["id"]: i % 2 == 0 for i, r in enumerate(rows)}
    got = weir.every_nth(sims.frame(spark, EVENTS), 5, rows_per_chunk=chunk).collect()
    assert {r.id for r in got} == {r["id"] for i, r in enumerate(rows) if i % 5 == 4}


def test_rules_in_force(spark, chunk):
    rules = [{"id": i, "t": t, "key": "r", "value": float(v)}
             for i, (t, v) in enumerate([(20, 50), (100, 200), (100, 10), (150, 90)])]
    got = weir.with_rules(
        sims.frame(spark, EVENTS),
        sims.frame(spark, rules).select("id", "ts", F.col("value").alias("limit")),
        rows_per_chunk=chunk,
    ).collect()
    want, now = {}, None
    for _, rank, r in sims.ordered(rules, EVENTS):
        if rank == 0:
            now = r["value"]
        else:
            want[r["id"]] = now
    assert {r.id: r.limit for r in got} == want


def test_sync_releases_late_rows_on_arrival(spark, chunk):
    rows = [("a", 23), ("b", 14), ("c", 10), ("d", -100), ("e", None)]
    df = spark.createDataFrame(
        [(i, sims.at(1), v, None if t is None else sims.at(t).timestamp() * 1000)
         for i, (v, t) in enumerate(rows)],
        "id long, ts timestamp, val string, time double",
    )
    got = weir.sync(df, "time", "5s", positions=True, rows_per_chunk=chunk).orderBy("pos").collect()
    assert [r.val for r in got] == ["d", "c", "b", "a"]
    assert [r.late for r in got] == [True, False, False, False]
    assert [sims.sec(r.release) for r in got] == [1, 15, 19, 28]


def test_dedupe_keeps_the_first(spark):
    got = weir.dedupe(sims.frame(spark, EVENTS), "key").collect()
    first = {}
    for _, _, r in sims.ordered(EVENTS):
        first.setdefault(r["key"], r["id"])
    assert {r.key: r.id for r in got} == first
    with pytest.raises(ValueError):
        weir.dedupe(sims.frame(spark, EVENTS), "value")


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_results_do_not_depend_on_partitioning(spark, partitions):
    df = sims.frame(spark, EVENTS).repartition(partitions)
    got = weir.rolling_count(df, "9s", rows_per_chunk=30).groupBy("Count").count()
    base = weir.rolling_count(sims.frame(spark, EVENTS), "9s").groupBy("Count").count()
    assert sorted(got.collect()) == sorted(base.collect())


def test_order_needs_an_id(spark):
    df = sims.frame(spark, EVENTS)
    with pytest.raises(ValueError):
        weir.toggle(df, id="nope")
    with pytest.raises(ValueError):
        weir.count_at(df, df, "1s", id="value")


def test_pack_by_interval_with_clears_and_flushes(spark, chunk):
    clears, flushes = [20, 50, 100, 199], [20, 30, 55, 100, 100, 101, 150]
    batch, want, start = [], [], 0

    def send(segment):
        parts = [tuple(batch[i:i + 4]) for i in range(0, len(batch), 4)] or [None]
        want.extend((start, segment, n, p) for n, p in enumerate(parts))

    arrived = sims.ordered(clears, flushes, EVENTS)
    for start in range(0, 200, 10):
        segment, batch = 0, []
        for t, rank, r in [a for a in arrived if start <= a[0] < start + 10]:
            if rank == 2:
                batch.append(r["id"])
                continue
            if rank == 1:
                send(segment)
            segment, batch = segment + 1, []
        send(segment)
    out = weir.pack_by_interval(
        sims.frame(spark, EVENTS), "10s", ticks=sims.times(spark, list(range(0, 200, 10))), pack_rows=4, rows_per_chunk=chunk,
        clears=sims.times(spark, clears), flushes=sims.times(spark, flushes))
    got = [(sims.sec(r.start), r.segment, r.Part, None if r.Pack is None else tuple(m.id for m in r.Pack)) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
