"""Paths, filters, maps, masks, arrays, spectra, encoding and scripts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import (
    decode_messages,
    dft_by_key,
    exists_key,
    fft,
    filter_messages,
    histogram_at,
    map_messages,
    mask,
    num,
    path,
    render_mail,
    script,
    to_messages,
    unpack,
)
from ..functions.expressions import label_text
from ..plans.tables import table
from .registry import HOUR, SQL_EVENTS, events, query, rounded, sql_ticks, ticks, us


@query("path", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(json_extract(props, '$.k') AS BIGINT) AS bracket FROM events
""")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    nested = F.concat(F.lit('{"b/c.d":[0,'), k, F.lit("]}"))
    return events(spark, d).select(
        "event_id",
        path(F.parse_json("props"), "$.k", "bigint").alias("k"),
        path(F.parse_json(nested), "$['b/c.d'][1]", "bigint").alias("bracket"),
    )


@query("expressions", """
SELECT event_id, event_type = 'click' AND value > 100 AS busy,
       event_type <> 'click' AND (value >= 100 OR user_id = 1) AS other FROM events
""")
def _(spark, d):
    return events(spark, d).select(
        "event_id", F.expr("event_type == 'click' AND value > 100").alias("busy"),
        F.expr("event_type != 'click' AND (value >= 100 OR user_id == 1)").alias("other"),
    )


@query("num", """
SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS number FROM events
""")
def _(spark, d):
    text = F.when(F.col("event_type") == "view", "n/a").otherwise(F.col("value").cast("string"))
    return events(spark, d).select("event_id", num(text).alias("number"))


@query("exists_key", """
SELECT event_id, event_type <> 'error' AS has_k, event_type = 'error' AS has_j FROM events
""")
def _(spark, d):
    text = F.when(F.col("event_type") == "error", '{"j":null}').otherwise(F.col("props"))
    return events(spark, d).select(
        "event_id", exists_key(text, "k").alias("has_k"),
        exists_key(text, "j").alias("has_j"),
    )


@query("label_text", """
WITH l AS (SELECT *, o_custkey * 4000 AS large, rtrim(CAST(o_custkey * 4000 AS VARCHAR), '0') AS digits,
  CAST(length(CAST(o_custkey * 4000 AS VARCHAR)) - 1 AS VARCHAR) AS exponent FROM orders)
SELECT o_orderkey, CASE WHEN o_custkey < 1000000 THEN CAST(o_custkey AS VARCHAR) END AS whole,
       CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag,
       CASE WHEN large < 1000000 THEN CAST(large AS VARCHAR) ELSE substr(digits, 1, 1)
            || CASE WHEN length(digits) > 1 THEN '.' || substr(digits, 2) ELSE '' END || 'e+' || lpad(exponent, 2, '0') END AS large
FROM l
""")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("even", F.col("o_custkey") % 2 == 0)
    o = o.withColumn("half", F.col("o_custkey").cast("double")).withColumn("large", F.col("o_custkey") * 4000.0)
    whole = F.when(F.col("o_custkey") < 1_000_000, label_text("half", "double"))
    return o.select("o_orderkey", whole.alias("whole"), label_text("even", "boolean").alias("flag"), label_text("large", "double").alias("large"))


@query("filter", "SELECT event_id, value FROM events WHERE event_type = 'purchase' AND value > 50")
def _(spark, d):
    return filter_messages(events(spark, d), "event_type = 'purchase' AND value > 50").select(
        "event_id", "value"
    )


@query("map_additive", """
SELECT event_id, value * 2 AS value, event_type || '!' AS shout, user_id AS in_user,
       value AS in_value FROM events
""")
def _(spark, d):
    rows = events(spark, d).select("event_id", "value", "event_type", "user_id")
    out = map_messages(rows, {
        "value": "value * 2", "shout": "concat(event_type, '!')",
        "inner": {"user": "user_id", "value": "value"}, "ignored": 7,
    })
    return out.select("event_id", "value", "shout", F.col("inner.user").alias("in_user"),
                      F.col("inner.value").alias("in_value"))


@query("map_only", 'SELECT event_type AS "Kind", value + 1 AS more FROM events')
def _(spark, d):
    return map_messages(events(spark, d), {"Kind": "event_type", "more": "value + 1"}, False)


@query("mask", "SELECT o_orderkey AS a, o_orderstatus AS d FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("f"),
        F.struct(F.col("o_orderpriority").alias("c"), F.col("o_orderstatus").alias("d")).alias("b"),
    )
    kept = mask(o, {"a": {}, "b": {"d": {}}, "unknown": {}})
    assert kept.columns == ["a", "b"]
    return kept.select("a", "b.*")


def _baskets(spark, d):
    line = F.struct("l_linenumber", "l_quantity", "l_returnflag")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(line).alias("lines")
    )


@query("unpack", "SELECT l_linenumber, l_quantity, l_returnflag FROM lineitem")
def _(spark, d):
    return unpack(_baskets(spark, d), "lines")


@query("unpack_label", 'SELECT l_orderkey AS "Label", l_quantity AS quantity FROM lineitem')
def _(spark, d):
    out = unpack(_baskets(spark, d), "lines", label="l_orderkey")
    return out.select("Label", F.col("Value.l_quantity").alias("quantity"))


def _hours(spark, d):
    """Events per hour of every day."""
    return events(spark, d).groupBy(
        F.to_date("ts").alias("day"), F.hour("ts").alias("idx")
    ).agg(F.count(F.lit(1)).cast("double").alias("value"))


SPECTRUM = f"""
WITH h AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS idx, count(*) AS v FROM events GROUP BY 1, 2),
f AS (SELECT unnest(range(24)) AS k)
SELECT CAST(day AS VARCHAR) AS day, CAST(k AS INT) AS k,
       round(sum(v * cos({2 * math.pi} * ((idx * k) % 24) / 24)) + 1e-9, 6) + 0.0 AS re,
       round(-sum(v * sin({2 * math.pi} * ((idx * k) % 24) / 24)) + 1e-9, 6) + 0.0 AS im
FROM h, f GROUP BY day, k
"""


def _spectrum(df):
    return df.select(F.col("day").cast("string").alias("day"), F.col("k").cast("int").alias("k"),
                     (rounded("re", "re") + 0.0).alias("re"),
                     (rounded("im", "im") + 0.0).alias("im"))


@query("dft_by_key", SPECTRUM)
def _(spark, d):
    return _spectrum(dft_by_key(_hours(spark, d), "day", "idx", "value", 24))


@query("fft", SPECTRUM)
def _(spark, d):
    grid = F.explode(F.sequence(F.lit(0), F.lit(23))).alias("idx")
    hours = _hours(spark, d)
    full = hours.select("day").distinct().select("day", grid).join(hours, ["day", "idx"], "left")
    point = F.struct("idx", F.col("idx").cast("double").alias("timestamp"), "value")
    series = full.groupBy("day").agg(F.sort_array(F.collect_list(point)).alias("series"))
    out = fft(series, "series").select("day", F.posexplode("fft").alias("k", "c"))
    return _spectrum(out.select("day", "k", F.col("c")[0].alias("re"), F.col("c")[1].alias("im")))


def _long_spectrum_sql(minutes: int, n: str) -> str:
    """The spectrum of all events per slot of so many minutes, of n points."""
    return f"""
WITH s AS (SELECT CAST(epoch_us(ts) // {60_000_000 * minutes} AS BIGINT) AS slot FROM events),
h AS (SELECT slot - (SELECT min(slot) FROM s) AS idx, CAST(count(*) AS DOUBLE) AS v FROM s GROUP BY 1),
m AS (SELECT max(idx) + 1 AS points FROM h), l AS (SELECT {n} AS n),
f AS (SELECT n, unnest(range(n)) AS k FROM l)
SELECT CAST(k AS BIGINT) AS k, round(sum(v * cos({2 * math.pi} * ((idx * k) % n) / n)) + 1e-9, 4) + 0.0 AS re,
       round(-sum(v * sin({2 * math.pi} * ((idx * k) % n) / n)) + 1e-9, 4) + 0.0 AS im
FROM h, f GROUP BY k
"""


def _slots(spark, d, minutes):
    """Events per slot, numbered from 0, and the number of slots."""
    slot = F.floor(F.unix_micros("ts") / F.lit(60_000_000 * minutes))
    counts = events(spark, d).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("value"))
    low, high = counts.agg(F.min("slot"), F.max("slot")).first()
    return counts.select(F.lit(0).alias("all"), (F.col("slot") - low).alias("idx"), "value"), high - low + 1


def _rounded_spectrum(df):
    return df.select("k", (rounded("re", "re", 4) + 0.0).alias("re"), (rounded("im", "im", 4) + 0.0).alias("im"))


@query("fft_long", _long_spectrum_sql(10, "(SELECT points FROM m)"))
def _(spark, d):
    slots, n = _slots(spark, d, 10)
    return _rounded_spectrum(dft_by_key(slots, "all", "idx", "value", n))


NEXT_PRIME = """(SELECT min(c) FROM (SELECT points + unnest(range(200)) AS c FROM m) WHERE c > 100
  AND NOT EXISTS (SELECT 1 FROM range(2, 2000) AS d(q) WHERE q * q <= c AND c % q = 0))"""


@query("fft_prime", _long_spectrum_sql(30, NEXT_PRIME))
def _(spark, d):
    slots, points = _slots(spark, d, 30)
    n = next(c for c in range(points, points + 200) if c > 100 and all(c % q for q in range(2, math.isqrt(c) + 1)))
    return _rounded_spectrum(dft_by_key(slots, "all", "idx", "value", n))


@query("to_messages", """
SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '"'
       || CASE WHEN event_type = 'click' THEN ',"user_id":' || user_id ELSE '' END || '}' AS message
FROM events
""")
def _(spark, d):
    user = F.when(F.col("event_type") == "click", F.col("user_id"))
    return to_messages(events(spark, d).select("event_id", "event_type", user.alias("user_id")))


@query("render_mail", """
SELECT event_id, 'From:' || event_type || chr(10) || 'To:' || user_id || chr(10) || 'Subject:'
       || event_id || chr(10) || chr(10) || props AS mail FROM events WHERE event_type <> 'error'
""")
def _(spark, d):
    e = events(spark, d).select(
        "event_id", F.nullif("event_type", F.lit("error")).alias("who"),
        F.col("user_id").cast("string").alias("to"), F.col("event_id").cast("string").alias("re"),
        "props",
    )
    return render_mail(e, "who", "to", "re", "props").select("event_id", "mail")


SCRIPTED = """
SELECT event_id, value * 2 + user_id AS score FROM events WHERE event_type <> 'error'
"""


@query("script_expr", SCRIPTED)
def _(spark, d):
    good = events(spark, d).where("event_type <> 'error'")
    return script(good, {"event_id": "event_id", "score": "value * 2 + user_id"})


@query("script_python", SCRIPTED)
def _(spark, d):
    def score(message: dict) -> dict:
        if message["event_type"] == "error":
            raise ValueError("an error message")
        return {"event_id": message["event_id"], "score": message["value"] * 2 + message["user_id"]}

    rows = events(spark, d).select("event_id", "event_type", "value", "user_id")
    return script(rows, score, "event_id bigint, score double")


def _variants(spark, d):
    """Events as messages without a schema; errors are arrays, and some views lack a member."""
    inner = F.struct(F.col("value").alias("value"), F.struct(F.col("user_id").alias("user"), F.lit(1).alias("n")).alias("who"))
    whole = F.struct("event_type", F.when(F.col("event_type") != "view", inner).alias("inner"), F.col("event_id").alias("x"))
    text = F.when(F.col("event_type") == "error", F.to_json(F.array("event_id"))).otherwise(F.to_json(whole))
    return events(spark, d).select("event_id", F.parse_json(text).alias("message"))


@query("mask_variant", """
SELECT event_id, event_type, CASE WHEN event_type <> 'view' THEN user_id END AS user, false AS has_x,
       event_type <> 'view' AS has_inner, false AS has_value FROM events WHERE event_type <> 'error'
""")
def _(spark, d):
    out = mask(_variants(spark, d), {"event_type": {}, "inner": {"who": {"user": {}}}, "none": {}}, "message")
    inner = F.try_variant_get("message", "$.inner", "variant")
    return out.select(
        "event_id", path("message", "$.event_type").alias("event_type"), path("message", "$.inner.who.user", "bigint").alias("user"),
        exists_key("message", "x", "variant").alias("has_x"), exists_key("message", "inner", "variant").alias("has_inner"),
        F.coalesce(exists_key(inner, "value", "variant"), F.lit(False)).alias("has_value"),
    )


@query("unpack_variant", """
SELECT event_id, pos, CASE pos WHEN 0 THEN event_type WHEN 1 THEN CAST(user_id AS VARCHAR) ELSE 'true' END AS label,
       event_type AS parent FROM events, (SELECT unnest(range(3)) AS pos) WHERE event_type <> 'error'
""")
def _(spark, d):
    element = lambda p, **v: F.to_json(F.struct(F.lit(p).alias("pos"), *[x.alias(n) for n, x in v.items()]))
    whole = F.concat(F.lit("["), element(0, v=F.col("event_type")), F.lit(","), element(1, v=F.col("user_id")), F.lit(","),
                     element(2, v=F.lit(True)), F.lit("]"))
    text = F.when(F.col("event_type") != "error", whole).otherwise(F.lit('{"no": "array"}'))
    rows = events(spark, d).select("event_id", "event_type", F.parse_json(text).alias("list"))
    out = unpack(rows, "list", "event_type", ["event_id"])
    return out.select(
        "event_id", path("Value", "$.pos", "bigint").alias("pos"),
        label_text(F.try_variant_get("Value", "$.v", "variant"), "variant").alias("label"), F.col("Label").alias("parent"),
    )


@query("decode_to_histogram", f"""
WITH {SQL_EVENTS}, {sql_ticks(6 * HOUR)},
v AS (SELECT t, CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR) WHEN 'view' THEN 'true' ELSE event_type END AS label
      FROM e WHERE event_type <> 'error'),
l AS (SELECT label, min(t) AS first FROM v GROUP BY 1),
live AS (SELECT p, label, count(*) AS n FROM polls JOIN v ON t BETWEEN p - {HOUR} AND p GROUP BY 1, 2)
SELECT p AS t_us, label AS "Label", CAST(coalesce(n, 0) AS DOUBLE) AS "Count"
FROM l JOIN polls ON first <= p LEFT JOIN live USING (p, label)
""")
def _(spark, d):
    tag = F.when(F.col("event_type") == "click", F.col("user_id").cast("string")).when(
        F.col("event_type") == "view", F.lit("true")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    text = F.concat(F.lit('{"other": 1, "tags": ['), tag, F.lit("]}"))
    payloads = events(spark, d).select(
        "event_id", "ts", F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(text).alias("payload"))
    messages = mask(decode_messages(payloads, "payload", keep=["event_id", "ts"]), {"tags": {}}, "message")
    tags = messages.withColumn("tags", F.try_variant_get("message", "$.tags", "variant"))
    each = unpack(tags, "tags", keep=["event_id", "ts"])
    out = histogram_at(each, ticks(spark, d, "6h"), "message", "1h", "ts", "event_id", long=True)
    return out.select(us(), "Label", "Count")
