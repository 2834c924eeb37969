"""Streams that come in many micro-batches give what the batch operators give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import sims
import weir
from weir import streaming

ROWS = [r for _, _, r in sims.ordered(sims.stream(21, 120, 100))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The rows in arrival order, cut into six files that are read one per micro-batch."""
    where = str(tmp_path_factory.mktemp("stream"))
    for i in range(0, 120, 20):
        sims.frame(spark, ROWS[i:i + 20]).coalesce(1).write.mode("append").parquet(where)
    return where


@pytest.fixture
def live(spark, folder):
    return (
        spark.readStream.schema("id long, ts timestamp, key string, value double")
        .option("maxFilesPerTrigger", 1).parquet(folder)
    )


def per_key(rows=ROWS):
    out = {}
    for r in rows:
        out.setdefault(r["key"], []).append(r)
    return out


def number(col):
    return F.get_json_object(col, "$.id").cast("int").alias(col)


def test_toggle(live):
    got = streaming.run_available(streaming.toggle_stream(live, "key"), "t").collect()
    assert {(r.id, r.state) for r in got} == {
        (r["id"], i % 2 == 0) for rows in per_key().values() for i, r in enumerate(rows)
    }


def test_pack(live):
    out = streaming.run_available(streaming.pack_by_count_stream(live, "key", 4), "p")
    ids = F.transform("Pack", lambda m: F.get_json_object(m, "$.id").cast("int")).alias("ids")
    got = out.select("key", "number", ids).orderBy("number").collect()
    for key, rows in per_key().items():
        assert [r.ids for r in got if r.key == key] == sims.packed(rows, 4)[0]


def test_queue(live):
    pushes, pops = live.where("id % 2 = 0"), live.where("id % 2 = 1")
    out = streaming.run_available(streaming.queue_stream(pushes, pops, "key"), "q")
    arrived = sims.in_batches(ROWS, 20, lambda r: r["id"] % 2)
    want = set()
    for key in per_key():
        mine = [a for a in arrived if a[2]["key"] == key]
        want |= set(sims.popped([], [], arrived=mine)[0])
    assert {tuple(r) for r in out.select("pop", number("message")).collect()} == want


def test_zip(live):
    out = streaming.run_available(
        streaming.zip_stream(live.where("id % 3 = 0"), live.where("id % 3 > 0"), "key"), "z")
    want = set()
    for rows in per_key().values():
        want |= set(sims.zipped([r for r in rows if r["id"] % 3 == 0],
                                [r for r in rows if r["id"] % 3]))
    assert {tuple(r) for r in out.select(number("A"), number("B")).collect()} == want


def test_cache(live):
    puts, asks = live.where("id % 2 = 0"), live.where("id % 2 = 1")
    out = streaming.run_available(
        streaming.cache_lookup_stream(asks, puts, "key", "value", "5s"), "c")
    want = sims.looked_up([], [], 5, sims.in_batches(ROWS, 20, lambda r: r["id"] % 2))
    got = {r.id: None if r.value is None else float(r.value) for r in out.collect()}
    assert got == want


def test_sync(live):
    times = live.withColumn("time", F.unix_millis("ts") - (F.col("id") % 7) * 2000)
    out = streaming.run_available(streaming.sync_stream(times, "key", "time", "6s"), "s")
    got = {r.id: (sims.sec(r.release), r.late) for r in out.collect()}
    end = max(r["t"] for r in ROWS)
    want = {}
    for r in ROWS:
        due = r["t"] - (r["id"] % 7) * 2 + 6
        if due < r["t"]:
            want[r["id"]] = (r["t"], True)
        elif due < end:
            want[r["id"]] = (due, False)
    assert got == want


def test_windows(live):
    out = streaming.run_available(streaming.count_stream(live, "20s", "10s"), "w").collect()
    polls = range(0, 200, 10)
    end = max(r["t"] for r in ROWS)
    assert {sims.sec(r.poll): r.Count for r in out} == {
        t: float(len(m)) for t, m in sims.live(ROWS, polls, 20).items() if m and t < end
    }
    packs = streaming.run_available(streaming.pack_by_interval_stream(live, "10s"), "i").collect()
    assert {sims.sec(r.start): [m.id for m in r.Pack] for r in packs} == {
        s: [r["id"] for r in ROWS if s <= r["t"] < s + 10]
        for s in range(0, 200, 10)
        if s + 10 <= end and any(s <= r["t"] < s + 10 for r in ROWS)
    }


def test_sessions_and_duplicates(live):
    out = streaming.run_available(streaming.session_stream(live, "key", "6s"), "n").collect()
    end = max(r["t"] for r in ROWS)
    by_id = {r["id"]: r for r in ROWS}
    want = [(k, float(len(ids))) for k, ids in sims.sessions(ROWS, 6)
            if max(by_id[i]["t"] for i in ids) + 6 <= end]
    assert sorted((r.key, r.Count) for r in out) == sorted(want)
    once = streaming.run_available(streaming.dedupe_stream(live, "key").select("key"), "d")
    assert sorted(r.key for r in once.collect()) == sorted(per_key())
    brief = streaming.run_available(
        streaming.dedupe_stream(live, "key", "ts", "1h").select("key"), "e")
    assert sorted(r.key for r in brief.collect()) == sorted(per_key())


def test_learning_takes_one_step_per_batch(spark, live, tmp_path):
    rows = live.select(F.lit(1.0).alias("x"), "value")
    streaming.learn_stream(rows, ["x"], "value", str(tmp_path / "p"), str(tmp_path / "c"), "linear",
                           "constant", eta=0.5).awaitTermination()
    got = streaming.read_params(spark, str(tmp_path / "p")).orderBy("batch").collect()
    assert [r.batch for r in got] == list(range(6)) and sum(r.rows for r in got) == 120
    steps = [r.params[0] for r in got]
    means = {}
    for a, b in zip([0.0, *steps], steps):
        means[(a, b)] = (b - a) / 0.5 + a  # the batch's mean value
    files = {round(np.mean([r["value"] for r in ROWS[i:i + 20]]), 9) for i in range(0, 120, 20)}
    assert {round(m, 9) for m in means.values()} == files


def arrivals(rank):
    """(time, rank, row) in the order in which the micro-batches bring them."""
    out = []
    for i in range(0, len(ROWS), 20):
        out += sims.ordered(*[[r for r in ROWS[i:i + 20] if rank(r) == k] for k in range(3)])
    return out


def test_panes(live):
    """Messages cost one row each; every finished poll is what the window holds, its ends included."""
    average = streaming.run_available(streaming.average_stream(live, "value", "20s", "5s"), "avg").collect()
    counts = streaming.run_available(streaming.histogram_stream(live, "key", "20s", "5s"), "hist").collect()
    last = max(r["t"] for r in ROWS)
    want, labels = {}, {}
    for p in range(0, last, 5):
        alive = [r for r in ROWS if p - 20 <= r["t"] <= p]
        if alive:
            want[p] = pytest.approx(sum(r["value"] for r in alive) / len(alive))
        for key in {r["key"] for r in ROWS if p - 25 <= r["t"] <= p}:
            now = sum(r["key"] == key for r in alive)
            if now or any(r["key"] == key and p - 25 <= r["t"] <= p - 5 for r in ROWS):
                labels[p, key] = float(now)
    assert {sims.sec(r.poll): r.Average for r in average} == want
    assert {(sims.sec(r.poll), r.Label): r.Count for r in counts} == labels


def test_timeseries(live):
    got = streaming.run_available(streaming.timeseries_stream(live, "key", "value", 3, "5s"), "series").collect()
    last, want = max(r["t"] for r in ROWS), {}
    for key, rows in per_key().items():
        for p in {-(-r["t"] // 5) * 5 for r in rows}:
            if p < last:
                want[key, p] = [r["value"] for r in rows if r["t"] <= p][-3:]
    assert {(r.key, sims.sec(r.poll)): [x.value for x in r.timeseries] for r in got} == want


def test_session_packs(live):
    out = streaming.run_available(streaming.pack_by_value_stream(live, "key", "3s", part_rows=4), "sessions")
    ids = F.transform("Pack", lambda m: F.get_json_object(m, "$.id").cast("int")).alias("ids")
    got = {(r.key, sims.sec(r.session), r.Part): r.ids for r in out.select("key", "session", "Part", ids).collect()}
    last, want = max(r["t"] for r in ROWS), {}
    for key, rows in per_key().items():
        sessions = []
        for r in rows:
            if not sessions or r["t"] - sessions[-1][-1]["t"] > 3:
                sessions.append([])
            sessions[-1].append(r)
        for s in sessions:
            parts = [s[i:i + 4] for i in range(0, len(s), 4)]
            open_still = s is sessions[-1] and s[-1]["t"] + 3 >= last
            for n, part in enumerate(parts[:-1] if open_still else parts):
                want[key, s[0]["t"], n] = [r["id"] for r in part]
    assert got == want and all(len(ids) <= 4 for ids in got.values())


@pytest.mark.parametrize("ttl", [None, 5])
def test_membership(live, ttl):
    adds, probes = live.where("id % 3 = 0"), live.where("id % 3 > 0")
    out = streaming.is_member_stream(probes, adds, "key", ttl=None if ttl is None else f"{ttl}s")
    added, want = {}, {}
    for t, rank, r in arrivals(lambda r: int(r["id"] % 3 > 0)):
        if rank == 0:
            added[r["key"]] = t if ttl is not None else added.get(r["key"], t)
        else:
            at = added.get(r["key"])
            want[r["id"]] = at is not None and (ttl is None or t - at <= ttl)
    assert {r.id: r.isMember for r in streaming.run_available(out, "member").collect()} == want


def test_zip_with_clears(live):
    kind = lambda r: 0 if r["id"] % 10 == 0 else 1 + r["id"] % 2
    clears, a, b = live.where("id % 10 = 0"), live.where("id % 10 > 0 AND id % 2 = 0"), live.where("id % 2 = 1")
    out = streaming.run_available(streaming.zip_clear_stream(a, b, clears, "key", shards=3), "zip-clear")
    epoch, waiting, seen, want = 0, {}, {}, set()
    for _, rank, r in arrivals(kind):
        if rank == 0:
            epoch, waiting, seen = epoch + 1, {}, {}
            continue
        idx = seen[r["key"], rank] = seen.get((r["key"], rank), -1) + 1
        other = waiting.pop((r["key"], 3 - rank, idx), None)
        if other is None:
            waiting[r["key"], rank, idx] = r["id"]
        else:
            want.add((r["key"], epoch, idx, *((r["id"], other) if rank == 1 else (other, r["id"]))))
    assert want and {tuple(r) for r in out.select("key", "epoch", "idx", number("A"), number("B")).collect()} == want


def test_packs_with_flushes_and_clears(live):
    kind = lambda r: 0 if r["id"] % 17 == 0 else 1 if r["id"] % 13 == 0 else 2
    clears, flushes = live.where("id % 17 = 0"), live.where("id % 17 > 0 AND id % 13 = 0")
    rows = live.where("id % 17 > 0 AND id % 13 > 0")
    out = streaming.run_available(streaming.pack_flush_stream(rows, "key", 3, flushes, clears, shards=3), "flush")
    open_packs, sent, want = {}, {}, set()

    def send(key):
        want.add((key, sent.setdefault(key, 0), tuple(open_packs.pop(key))))
        sent[key] += 1

    for _, rank, r in arrivals(kind):
        if rank == 0:
            open_packs.clear()
        elif rank == 1:
            for key in list(open_packs):
                send(key)
        else:
            if len(open_packs.get(r["key"], [])) == 3:
                send(r["key"])
            open_packs.setdefault(r["key"], []).append(r["id"])
    ids = F.transform("Pack", lambda m: F.get_json_object(m, "$.id").cast("int")).alias("ids")
    got = {(r.key, r.number, tuple(r.ids)) for r in out.select("key", "number", ids).collect()}
    assert got == want


def test_rules(live):
    rules, rows = live.where("id % 9 = 0"), live.where("id % 9 > 0")
    out = streaming.run_available(streaming.with_rules_stream(rows, rules, shards=3), "rules")
    rule, want = None, {}
    for _, rank, r in arrivals(lambda r: int(r["id"] % 9 > 0)):
        if rank == 0:
            rule = r["id"]
        else:
            want[r["id"]] = rule
    assert {r.id: r.rule for r in out.select("id", number("rule")).collect()} == want
