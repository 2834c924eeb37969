"""Sources, single-message operators, models, samplers and sinks on small literal inputs."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import sims
import weir
from weir.functions.duration import interval_micros, parse_duration, window_micros
from weir.functions.expressions import array_literal, count_le, label_text, with_count_le
from weir.sources.messages import csv_records


@pytest.mark.parametrize("text,want", [
    ("10ms", 10_000), ("1m0s", 60_000_000), ("5h", 18_000_000_000), ("1.5s", 1_500_000),
    ("-2m", -120_000_000), ("+3us", 3), ("3µs", 3), ("1500ns", 1), ("0", 0), ("1h2m3s4ms", 3_723_004_000),
    (".5s", 500_000),
])
def test_durations(text, want):
    assert parse_duration(text) == want


@pytest.mark.parametrize("text", ["", "10", "1x", "s", "1s2", "1 s", None, 5])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)


def test_duration_limits():
    assert window_micros("0s") == 0
    for bad in ("-1s", "0s"):
        with pytest.raises(ValueError):
            interval_micros(bad)


def test_label_text(spark):
    cases = {
        1.0: "1", 0.0001: "0.0001", 123456.0: "123456", 1e6: "1e+06", 1234567.0: "1.234567e+06",
        1e-5: "1e-05", 123456789.0: "1.23456789e+08", 0.5: "0.5", -2.25: "-2.25", 0.0: "0",
        1.5e100: "1.5e+100", 100.0: "100", 0.00123: "0.00123", -1e-7: "-1e-07", 99999.5: "99999.5",
        math.inf: "+Inf", -math.inf: "-Inf",
    }
    df = spark.createDataFrame([(v,) for v in cases], "v double")
    got = {r.v: r.t for r in df.select("v", label_text("v", "double").alias("t")).collect()}
    assert got == cases
    other = spark.createDataFrame([(True, 7, "x", [1])], "b boolean, i int, s string, a array<int>")
    row = other.select(*[label_text(c, t).alias(c) for c, t in other.dtypes]).first()
    assert tuple(row) == ("true", "7", "x", None)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 8, 9])
def test_with_count_le(spark, size):
    bounds = [i * 10 for i in range(size)]
    df = spark.range(-5, 100, 5)
    out = with_count_le(df, "n", array_literal(bounds, "array<bigint>"), size, F.col("id"))
    structs = array_literal([{"k": b} for b in bounds], "array<struct<k:bigint>>")
    key = F.struct(F.col("id").alias("k")).cast("struct<k:bigint>")
    for r in out.withColumn("m", count_le(structs, size, key)).collect():
        assert r.n == r.m == sum(b <= r.id for b in bounds)


def test_paths_and_keys(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,2]},"b/c.d":["x","y"],"n":null}',)], "j string")
    v = F.parse_json("j")
    row = df.select(
        weir.path(v, "$.a.b[1]", "int"), weir.path(v, "$['b/c.d'][1]"), weir.path(v, "$.zzz"),
        weir.path(v, "$.a.b", "int"), weir.exists_key("j", "n"), weir.exists_key("j", "q"),
        weir.exists_key(v, "n", "variant"), weir.num(F.lit("1.5")), weir.num(F.lit("x")),
        weir.exists_key(F.create_map(F.lit("k"), F.lit(1)), "k", "map"),
    ).first()
    assert tuple(row) == (2, "y", None, None, True, False, True, 1.5, None, True)


def test_filter(spark):
    df = spark.createDataFrame([("iPhone",), ("Android",), (None,)], "device string")
    assert [r.device for r in weir.filter_messages(df, "device = 'iPhone'").collect()] == ["iPhone"]
    assert weir.filter_messages(df).count() == 2


def test_map(spark):
    df = spark.createDataFrame([("something", "another thing")], "bar string, foo string")
    only = weir.map_messages(df, {"MegaBar": "bar"}, additive=False)
    assert only.columns == ["MegaBar"] and only.first().MegaBar == "something"
    both = weir.map_messages(df, {"foo": "bar", "bar": "foo", "deep": {"x": {"y": "foo"}, "n": 3}})
    assert both.first().asDict(True) == {
        "bar": "another thing", "foo": "something", "deep": {"x": {"y": "another thing"}},
    }


def test_mask(spark):
    df = spark.sql("""SELECT 24.0D AS a, named_struct('c', 'test', 'd', array(1.0D, 3.0D, 4.0D)) AS b,
                   5.0D AS f, named_struct('y', 5.0D, 'z', 10.0D) AS x""")
    got = weir.mask(df, {"a": {}, "b": {"d": {}}, "x": {}, "none": {}}).first().asDict(True)
    assert got == {"a": 24.0, "b": {"d": [1.0, 3.0, 4.0]}, "x": {"y": 5.0, "z": 10.0}}
    assert weir.mask(df, {}).columns == df.columns
    assert weir.mask(df, {"a": {"below": {}}}).first().a == 24.0
    empty = weir.mask(df, {"b": {"nothing": {}}})
    assert weir.to_messages(empty).first().message == '{"b":{}}'


def test_unpack(spark):
    df = spark.sql("SELECT array(named_struct('b', 'test')) AS a, 'p' AS l, array(1, 2) AS n")
    assert weir.unpack(df, "a").first().asDict() == {"b": "test"}
    assert [r.Value for r in weir.unpack(df, "n").collect()] == [1, 2]
    assert {(r.Value, r.Label) for r in weir.unpack(df, "n", "l").collect()} == {(1, "p"), (2, "p")}
    for bad in (("l", None), ("n", "n")):
        with pytest.raises(ValueError):
            weir.unpack(df, *bad)
    assert weir.unpack(spark.sql("SELECT CAST(NULL AS array<int>) AS n"), "n").count() == 0


def test_read_messages(spark, tmp_path):
    lines = ['{"Name": "Mike", "Dog": "Kenny"}', "no json", '{"Name": "Nik", "Dog": "Ziggy"}']
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    got = weir.read_messages(spark, str(tmp_path), "Name string, Dog string")
    assert {tuple(r) for r in got.collect()} == {
        ("Mike", "Kenny", None), ("Nik", "Ziggy", None), (None, None, "no json"),
    }
    free = weir.read_messages(spark, str(tmp_path))
    texts = {r[0] for r in free.select(F.to_json("message")).collect()}
    assert '{"data":"no json"}' in texts and len(texts) == 3


def test_decode(spark):
    xml = "<OdfBody><x/></OdfBody>"
    df = spark.createDataFrame([(1, '{"a":1}'), (2, xml), (3, None), (4, "[1,2]")], "id int, p string")
    got = weir.decode_messages(df, "p", keep=["id"]).select("id", F.to_json("message").alias("m"))
    assert {(r.id, r.m) for r in got.collect()} == {
        (1, '{"a":1}'), (2, '{"data":"<OdfBody><x/></OdfBody>"}'), (4, "[1,2]"),
    }
    assert weir.decode_messages(df, "p", "drop").count() == 2
    with pytest.raises(ValueError):
        weir.decode_messages(df, "p", "ignore")


def test_parse_csv(spark):
    text = ('  name1,  a@x, 1\nname2, b@x, 2\n\nname3,c@x\r\n"na""me, 4", "d\n@x",4, extra, more\n')
    df = spark.createDataFrame([(text,), ("",)], "data string")
    rows = weir.parse_csv(df, "data", ["name", "email", "phone"]).orderBy("record").collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("name1", "a@x", "1", None), ("name2", "b@x", "2", None), ("name3", "c@x", None, None),
        ('na"me, 4', "d\n@x", "4", {"3": "extra", "4": "more"}),
    ]


def csv_by_state(text):
    """Records of a CSV text, character by character: fields, or the text of a malformed record."""
    text = text.replace("\r\n", "\n").removesuffix("\r")
    out, at = [], 0
    while at < len(text):
        if text[at] == "\n":
            at += 1
            continue
        start, fields, bad = at, [], False
        while True:
            while at < len(text) and text[at] in " \t":
                at += 1
            if text[at:at + 1] == '"':
                at, field = at + 1, ""
                while at < len(text):
                    if text[at] != '"':
                        field, at = field + text[at], at + 1
                    elif text[at + 1:at + 2] == '"':
                        field, at = field + '"', at + 2
                    else:
                        break
                bad = at >= len(text) or text[at + 1:at + 2] not in ("", ",", "\n")
                at += 1
            else:
                end = at
                while end < len(text) and text[end] not in ',"\n':
                    end += 1
                field, bad, at = text[at:end], text[end:end + 1] == '"', end
            fields.append(field)
            if bad or text[at:at + 1] != ",":
                break
            at += 1
        end = text.find("\n", at) if at < len(text) else -1
        at = len(text) if end < 0 else end + 1
        out.append((None, text[start:at]) if bad else (fields, None))
    return out


def test_csv_against_an_automaton(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice('ab,,""\n\n \t') for _ in range(rng.randrange(40))) for _ in range(600)]
    texts += ['a,b"c,d\n1,2', '"open\nmore', '"a" b\nc', '""\n""""\n"a""', '"x\r\ny",z\r\n', ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, data string")
    got = {r.id: [(x.fields, x.malformed) for x in r.records] for r in df.select("id", csv_records("data").alias("records")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == csv_by_state(t), t
    kept = weir.parse_csv(df, "data", ["a"], ["id"], on_error="keep").where("malformed IS NOT NULL").count()
    assert kept == sum(m is not None for t in texts for _, m in csv_by_state(t))


def test_variant_messages(spark):
    texts = ['{"a":24,"b":{"c":"test","d":[1,3,4]},"f":5,"x":{"y":5,"z":null}}', "[1]", '"text"', '{"b":7}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.try_parse_json("text").alias("message"))
    keys = {"a": {}, "b": {"d": {}}, "x": {}, "none": {}}
    got = {r[0]: r[1] and json.loads(r[1]) for r in weir.mask(df, keys, "message").select("id", F.to_json("message")).collect()}
    assert got == {0: {"a": 24, "b": {"d": [1, 3, 4]}, "x": {"y": 5, "z": None}}, 3: {"b": 7}}
    inner = weir.mask(df, {"id": {}, "message": {"b": {"d": {"e": {}}}}}).select("id", F.to_json("message")).collect()
    assert {r[0]: r[1] and json.loads(r[1]) for r in inner} == {0: {"b": {"d": [1, 3, 4]}}, 1: [1], 2: "text", 3: {"b": 7}, 4: None}
    maps = spark.sql("SELECT map('a', map('b', 1, 'c', 2), 'd', map('b', 3)) AS m, map('a', 1, 'b', 2) AS flat")
    assert weir.mask(maps, {"m": {"a": {"c": {}}}, "flat": {"b": {}}}).first() == ({"a": {"c": 2}}, {"b": 2})
    lists = spark.createDataFrame([(1, '[1, "x", {"q": true}]'), (2, '{"no": 1}'), (3, None)], "id int, text string").select(
        "id", F.try_parse_json("text").alias("list"))
    assert [r[0] for r in weir.unpack(lists, "list").select(F.to_json("message")).collect()] == ["1", '"x"', '{"q":true}']
    assert [tuple(r) for r in weir.unpack(lists, "list", "id", ["id"]).select("id", F.to_json("Value"), "Label").collect()] == [
        (1, "1", 1), (1, '"x"', 1), (1, '{"q":true}', 1)]
    values = spark.sql("SELECT explode(array('1', '1.5', '1e6', 'true', '\"t\"', 'null', '[1]', '{}')) AS v").select(F.parse_json("v").alias("v"))
    assert [r[0] for r in values.select(weir.label_text("v", "variant")).collect()] == ["1", "1.5", "1e+06", "true", "t", None, None, None]


def test_parse_long_csv_text_whole(spark):
    n = 30_000
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(
        F.lit('"x ""'), i.cast("string"), F.lit('"""'), F.lit(",y"))), "\n")
    df = spark.range(1).select(text.alias("data"))
    out = weir.parse_csv(df, "data", ["a", "b"])
    assert out.count() == n
    assert out.where(F.col("record") == n - 1).first().a == f'x "{n}"'


def test_parse_xml(spark):
    xml = ('<OdfBody DocumentType="DT_GM"><Competition Code="OG2014"><Unit>1</Unit><Unit>2</Unit>'
           "</Competition></OdfBody>")
    df = spark.createDataFrame([(xml,)], "data string")
    schema = "DocumentType string, Competition struct<Code: string, Unit: array<int>>"
    row = weir.parse_xml(df, "data", "OdfBody", schema).first()
    assert row.OdfBody.asDict(True) == {
        "DocumentType": "DT_GM", "Competition": {"Code": "OG2014", "Unit": [1, 2]},
    }
    free = weir.parse_xml(df, "data", "OdfBody")
    assert free.select(weir.path("OdfBody", "$.Competition._Code")).first()[0] == "OG2014"


@pytest.mark.parametrize("chunk", [None, 2])
def test_split_frames(spark, chunk):
    pieces = ['{"a":', '1}\n{"b":2}\n', "\r\n", 'x', '\r\n', '{"open":1']
    rows = [("c", i, p) for i, p in enumerate(pieces)] + [("d", 0, '{"z":1}\n')]
    df = spark.createDataFrame(rows, "conn string, n int, chunk string")
    got = weir.split_frames(df, "chunk", "n", "conn", rows_per_chunk=chunk).collect()
    assert sorted((r.conn, r.frame, r.piece, r.payload) for r in got) == [
        ("c", 0, 0, '{"a":1}'), ("c", 0, 1, '{"b":2}'), ("c", 2, 0, "x"), ("d", 0, 0, '{"z":1}'),
    ]


def test_ticks(spark):
    start = dt.datetime(2024, 1, 1)
    grid = weir.tick_grid(spark, start, start + dt.timedelta(seconds=5), "2s").collect()
    assert [(r.tick, sims.sec(r.ts)) for r in grid] == [(0, 0), (1, 2), (2, 4)]
    with pytest.raises(ValueError):
        weir.tick_grid(spark, start, start, "0s")
    df = sims.times(spark, [3, 7, 11])
    got = weir.ticks_over(df, "5s", per_row=2).orderBy("tick").collect()
    assert [sims.sec(r.ts) for r in got] == [0, 5, 10, 15]
    assert weir.ticks_over(df.limit(0), "5s").count() == 0
    assert tuple(weir.bang(df, F.max("ts")).select("Bang").first()) == ("!",)
    assert weir.tick_stream(spark, "500ms").isStreaming


def test_enrich_by_url(spark):
    asks = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "gone"), (4, None), (5, "u1")],
                                 "id int, link string")
    answers = spark.createDataFrame(
        [("u1", '{"old":1}', "200 OK", 1), ("u1", '{"v":1}', "200 OK", 2), ("u2", "<x/>", "404", 1)],
        "url string, body string, status string, at int")
    got = weir.enrich_by_url(asks, "link", answers, order="at")
    assert {(r.id, r.j) for r in got.select("id", F.to_json("response").alias("j")).collect()} == {
        (1, '{"v":1}'), (5, '{"v":1}'), (2, '{"data":"<x/>"}'),
    }
    got = weir.enrich_by_url(asks, "link", answers, "envelope", order="at").select(
        "id", F.to_json("response.body").alias("b"), "response.status")
    assert {tuple(r) for r in got.collect()} == {
        (1, '{"v":1}', "200 OK"), (5, '{"v":1}', "200 OK"), (2, '"<x/>"', "404"),
    }


def test_scripts(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, s string")
    got = weir.script(df, lambda m: {"n": m["id"] * 2, "s": m["s"].upper()}, "n int, s string")
    assert {tuple(r) for r in got.collect()} == {(2, "A"), (6, "C")}
    assert weir.script(df, {"n": "id + 1"}).columns == ["n"]
    with pytest.raises(ValueError):
        weir.script(df, lambda m: m)


def test_membership(spark):
    adds = spark.createDataFrame([("a", sims.at(5)), ("a", sims.at(1)), ("b", sims.at(9))],
                                 "key string, ts timestamp")
    probes = spark.createDataFrame(
        [(0, "a", sims.at(0)), (1, "a", sims.at(1)), (2, "b", sims.at(8)), (3, "b", sims.at(9)),
         (4, None, sims.at(9)), (5, "c", sims.at(9))], "id int, key string, ts timestamp")
    got = {r.id: r.isMember for r in weir.is_member(probes, adds, "key").collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False, 5: False}
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(weir.keep_members(probes, adds, "key", "ts")) == [1, 3]
    assert ids(weir.drop_members(probes, adds, "key", "ts")) == [0, 2, 4, 5]
    assert ids(weir.keep_members(probes, adds, "key")) == [0, 1, 2, 3]
    assert ids(weir.drop_members(probes, adds, "key")) == [4, 5]
    assert weir.cardinality(adds, "key").first().cardinality == 2.0
    assert weir.cardinality(adds, "key", approx=True).first().cardinality == 2.0


def test_cache_snapshot(spark):
    puts = spark.createDataFrame(
        [(0, sims.at(0), "Morning Post", "100"), (1, sims.at(0), "Morning Post", "4"),
         (2, sims.at(0), "Evening/News", "50")], "id int, ts timestamp, name string, count string")
    at = lambda s: F.lit(sims.at(s))
    got = weir.cache_snapshot(puts, "name", "count", at(60), "1m").collect()
    assert {tuple(r) for r in got} == {("Morning Post", "4"), ("Evening/News", "50")}
    assert weir.cache_snapshot(puts, "name", "count", at(61), "1m").count() == 0
    keys = spark.createDataFrame([("Evening/News",), ("x",)], "name string")
    got = weir.cache_lookup_keys(puts, keys, "name", "count", at(1), "1m").collect()
    assert {tuple(r) for r in got} == {("Evening/News", "50"), ("x", None)}


def test_null_puts_are_puts(spark):
    puts = spark.createDataFrame([(0, sims.at(0), "k", 1.0), (1, sims.at(1), "k", None)],
                                 "id int, ts timestamp, key string, value double")
    asks = spark.createDataFrame([(2, sims.at(2), "k")], "id int, ts timestamp, key string")
    assert weir.cache_lookup(asks, puts, "key", "value", "1h").first().value is None


def _kl(p, q):
    """The divergence step by step."""
    eps = 0.0001
    p, q = ({k: v or eps for k, v in h.items()} for h in (p, q))
    p, q = ({k: v / sum(h.values()) for k, v in h.items()} for h in (p, q))
    for a, b in ((q, p), (p, q)):
        for k in b:
            a.setdefault(k, eps)
        z = sum(a.values())
        for k in a:
            a[k] /= z
    return sum(math.log(v / q[k]) * v for k, v in p.items())


@pytest.mark.parametrize("p,q", [
    ({"a": 1, "b": 3}, {"a": 2, "b": 2}), ({"a": 1, "b": 0}, {"a": 5, "c": 2}),
    ({"a": 4}, {"b": 1, "c": 0}), ({"a": 4}, {"a": 4}),
])
def test_kl(spark, p, q):
    long = lambda h: spark.createDataFrame(
        [("g", k, float(v)) for k, v in h.items()], "g string, Label string, Count double")
    assert weir.kl_divergence(long(p), long(q)).first().KL == pytest.approx(_kl(p, q), abs=1e-9)
    by = weir.kl_divergence(long(p), long(q), ["g"]).first()
    assert (by.g, by.KL) == ("g", pytest.approx(_kl(p, q), abs=1e-9))
    kind = "array<struct<Label:string,Count:double>>"
    rows = spark.createDataFrame(
        [(1, [(k, float(v)) for k, v in p.items()], [(k, float(v)) for k, v in q.items()]),
         (2, None, [])], f"id int, p {kind}, q {kind}")
    assert [r.KL for r in weir.kl_divergence_arrays(rows, "p", "q").collect()] == [
        pytest.approx(_kl(p, q), abs=1e-9)]


def test_fft(spark):
    values = [1.0, 2.5, -3.0, 0.0, 4.0]
    rows = [([(float(i), v) for i, v in enumerate(values)],), (None,), ([],)]
    df = spark.createDataFrame(rows, "s array<struct<timestamp:double,value:double>>")
    got = [r.fft for r in weir.fft(df, "s").collect()]
    want = np.fft.fft(values)
    assert np.allclose([complex(*c) for c in got[0]], want) and got[1] is None and got[2] == []
    long = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)],
                                 "key string, idx int, value double")
    back = {r.k: complex(r.re, r.im) for r in weir.dft_by_key(long, "key", "idx", "value", 5).collect()}
    assert np.allclose([back[k] for k in range(5)], want)


def test_models(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, 0.0, 0.0)],
                               "id int, x double, y double")
    got = {r.id: r.Response for r in weir.linear_model(df, ["x", "y"], [2.0, 3.0]).collect()}
    assert got == {1: 8.0, 3: 0.0}
    with pytest.raises(ValueError):
        weir.linear_model(df, ["x"], [1.0, 2.0])
    p = weir.logistic_model(df, ["x"], [1.0], mode="probability").collect()
    assert {r.id: r.Response for r in p} == {1: pytest.approx(1 / (1 + math.exp(-1))), 3: 0.5}
    drawn = weir.logistic_model(df, ["x"], [1.0])
    assert drawn.collect() == drawn.repartition(3).orderBy("id").collect()


def test_learning(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = x @ [1.5, -0.5]
    rows = [(float(a), float(b), float(c), float(c > 0)) for (a, b), c in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, y double, side double").persist()
    assert weir.learn_linear(df, ["a", "b"], "y").first().params == pytest.approx([1.5, -0.5])
    steps = weir.learn(df, ["a", "b"], "y", "linear", "constant", None, 60, 0.3).first().params
    assert steps == pytest.approx([1.5, -0.5], abs=1e-3)
    for step in ("inverse", "bottou", "constant"):
        w = weir.learn(df, ["a", "b"], "side", "logistic", step, [0.0, 0.0], 5, 2.0).first().params
        assert w[0] > 0 > w[1]
    for bad in ({"loss": "x"}, {"step": "x"}, {"init": [1.0]}):
        with pytest.raises(ValueError):
            weir.learn(df, ["a", "b"], "side", **bad)
    df.unpersist()


def test_samplers(spark):
    df = spark.range(20_000)
    draws = {
        "poisson": (weir.with_poisson(df, rate=4.0), 4.0, 4.0),
        "gauss": (weir.with_gaussian(df, mean=1.0, std=3.0), 1.0, 9.0),
        "exp": (weir.with_exponential(df, rate=2.0), 0.5, 0.25),
        "cat": (weir.with_categorical(df, [1, 0, 3]), 1.5, 0.75),
    }
    for name, (out, mean, var) in draws.items():
        r = out.agg(F.avg("sample").alias("m"), F.var_samp("sample").alias("v")).first()
        assert abs(r.m - mean) < 6 * math.sqrt(var / 20_000), name
        assert abs(r.v - var) < 0.15 * var, name
    assert weir.with_categorical(df, [1, 0, 3]).where("sample = 1").count() == 0
    zipf = weir.with_zipf(df, s=2.0, v=5.0, n=9).groupBy("sample").count().collect()
    weights = [(5 + k) ** -2.0 for k in range(10)]
    for r in zipf:
        p = weights[int(r.sample)] / sum(weights)
        assert abs(r["count"] - 20_000 * p) < 6 * math.sqrt(20_000 * p)
    one = weir.with_gaussian(df).orderBy("id").collect()
    assert weir.with_gaussian(df.repartition(5)).orderBy("id").collect() == one
    for bad in ([], [0.0, 0.0], [-1.0, 2.0]):
        with pytest.raises(ValueError):
            weir.with_categorical(df, bad)


def test_pack_by_interval(spark):
    rows = [{"id": i, "t": t, "key": "a", "value": 0.0} for i, t in enumerate([0, 1, 1, 12, 19])]
    df = sims.frame(spark, rows)
    grid = weir.tick_grid(spark, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 15), "5s")
    got = weir.pack_by_interval(df, "5s", ticks=grid).orderBy("start").collect()
    assert [(sims.sec(r.start), r.Pack and [m.id for m in r.Pack]) for r in got] == [
        (0, [0, 1, 2]), (5, None), (10, [3]), (15, [4])]
    shifted = weir.pack_by_interval(df, "5s", start=F.lit(sims.at(2))).orderBy("start").collect()
    assert [sims.sec(r.start) for r in shifted] == [-3, 12, 17]
    parts = weir.pack_by_interval(df, "5s", pack_rows=1).collect()
    assert sorted(m.id for r in parts for m in r.Pack) == [0, 1, 2, 3, 4]
    cut = lambda n: sorted(
        (sims.sec(r.start), r.Part, [m.id for m in r.Pack])
        for r in weir.pack_by_interval(df.repartition(n), "5s", pack_rows=2, rows_per_chunk=2).collect())
    assert cut(1) == cut(7) == [(0, 0, [0, 1]), (0, 1, [2]), (10, 0, [3]), (15, 0, [4])]
    beside = weir.pack_by_interval(df, "5s", start=F.lit(sims.at(2)), ticks=grid).collect()
    assert sorted(m.id for r in beside for m in r.Pack or []) == [0, 1, 2, 3, 4]


def test_decode_keeps_what_no_schema_fits(spark):
    texts = ['{"a": 1}', "[1,2]", "3", '{"a": "x"}', "no", '{"b": 2}']
    rows = weir.decode_messages(spark.createDataFrame([(t,) for t in texts], "p string"), "p", schema="a bigint").collect()
    assert [(r.a, r.data) for r in rows] == [(1, None), *[(None, t) for t in texts[1:5]], (None, None)]


def test_messages_keep_microseconds(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00.172425' AS ts")
    assert weir.to_messages(df).first().message == '{"ts":"2024-01-01T00:00:00.172425Z"}'


def test_batches_and_publishing(spark, tmp_path):
    rows = sims.stream(11, 23, 30)
    df = sims.frame(spark, rows).select("id", "ts")
    order = [r["id"] for _, _, r in sims.ordered(rows)]
    got = weir.batch_payloads(df, 5, dest=F.lit("topic"), rows_per_chunk=6).orderBy("batch").collect()
    assert [len(r.payloads) for r in got] == [5, 5, 5, 5, 3] and got[0].dest == "topic"
    texts = [p for r in got for p in r.payloads]
    assert [int(t.split('"id":')[1].split(",")[0]) for t in texts] == order
    got = weir.batch_payloads(df, 4, interval="10s", rows_per_chunk=6).collect()
    want = {}
    for _, _, r in sims.ordered(rows):
        want[r["t"] // 10] = want.get(r["t"] // 10, 0) + 1
    sizes = {}
    for r in got:
        assert len(r.payloads) <= 4
        k = sims.sec(r.start) // 10
        sizes[k] = sizes.get(k, 0) + len(r.payloads)
    assert sizes == want

    folder = str(tmp_path)

    def send(batch, folder=folder):
        import os
        import uuid

        assert len(batch) <= 4
        with open(os.path.join(folder, uuid.uuid4().hex), "wb") as f:
            f.write(b"\n".join(batch) + b"\n")

    weir.publish(df, send, max_batch=4)
    sent = [line for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    assert len(sent) == 23


def test_files_and_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    weir.write_messages(df, str(tmp_path / "out"))
    back = {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert back == {'{"id":1,"s":"a"}', '{"id":2}'}
    docs = weir.bulk_docs(df, "idx", "id").orderBy("document").collect()
    assert docs[0].action == '{"index":{"_index":"idx","_id":"1"}}'
    mail = spark.createDataFrame([("f", "t", "s", "m"), ("f", None, "s", "m")],
                                 "f string, t string, s string, m string")
    assert [r.mail for r in weir.render_mail(mail, "f", "t", "s", "m").collect()] == [
        "From:f\nTo:t\nSubject:s\n\nm"]
    weir.show_messages(df, 1)


def test_merge(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "y")], "x int, y string")
    assert {tuple(r) for r in weir.merge(a, b).collect()} == {(1, None), (2, "y")}


def test_fire_at_ticks(spark):
    rows = sims.stream(12, 300, 400, keys=2, hot=0.2)
    tick, window, threshold = 5, 20, 6
    got = weir.fire_at_ticks(sims.frame(spark, rows), "key", threshold, "5s", "20s").collect()
    want = []
    for key in {r["key"] for r in rows}:
        live = []
        mine = sorted((r for r in rows if r["key"] == key), key=lambda r: r["t"])
        for p in range(0, 500, tick):
            live += [r for r in mine if p - tick < r["t"] <= p]
            live = [r for r in live if r["t"] >= p - window]
            if len(live) >= threshold:
                want.append((key, p, float(len(live))))
                live = []
    assert sorted((r.key, sims.sec(r.at), r.Count) for r in got) == sorted(want)
    with pytest.raises(ValueError):
        weir.fire_at_ticks(sims.frame(spark, rows), "key", 2, "7s", "20s")
