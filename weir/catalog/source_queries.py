"""Sources and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import (
    bang,
    decode_messages,
    enrich_by_url,
    parse_csv,
    parse_xml,
    path,
    read_messages,
    split_frames,
)
from ..plans.tables import scratch_path, table
from .registry import HOUR, events, query, sql_ticks, ticks, us


def _lines(spark, d):
    """Events as JSON lines; errors are broken lines."""
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    broken = F.concat(F.lit("{broken "), F.col("event_id").cast("string"))
    return events(spark, d).select(
        F.when(F.col("event_type") == "error", broken).otherwise(good).alias("line")
    )


DECODED = """
SELECT CASE WHEN event_type <> 'error' THEN event_id END AS event_id,
       CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
       CASE WHEN event_type <> 'error' THEN value END AS value,
       CASE WHEN event_type = 'error' THEN '{broken ' || event_id END AS data
FROM events
"""
MESSAGE = "event_id bigint, event_type string, value double"


@query("read_messages", DECODED)
def _(spark, d):
    where = scratch_path(spark, "lines")
    _lines(spark, d).write.text(where)
    return read_messages(spark, where, MESSAGE)


@query("decode_messages", DECODED)
def _(spark, d):
    return decode_messages(_lines(spark, d), "line", "data", MESSAGE)


@query("decode_messages_strict",
       "SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'")
def _(spark, d):
    return decode_messages(_lines(spark, d), "line", "drop", MESSAGE)


@query("decode_messages_variant", """
SELECT CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
       CASE WHEN event_type = 'error' THEN '{broken ' || event_id END AS data
FROM events
""")
def _(spark, d):
    out = decode_messages(_lines(spark, d), "line")
    return out.select(path("message", "$.event_type").alias("event_type"),
                      path("message", "$.data").alias("data"))


@query("parse_csv", """
SELECT c_custkey AS custkey, 0 AS record, c_name AS name, c_mktsegment AS segment,
       CAST(c_nationkey AS VARCHAR) AS nation, CAST(NULL AS VARCHAR) AS extra FROM customer
UNION ALL
SELECT c_custkey, 1, c_name || ', "Mr"' || chr(10) || 'second line', NULL, NULL, NULL FROM customer
UNION ALL
SELECT c_custkey, 2, c_name, '', 'x', 'more' FROM customer
""")
def _(spark, d):
    name = F.col("c_name")
    text = F.concat(
        name, F.lit(",  "), F.col("c_mktsegment"), F.lit(", "), F.col("c_nationkey").cast("string"),
        F.lit('\n\n"'), name, F.lit(', ""Mr""\nsecond line"\r\n'),
        name, F.lit(",, x, more\n"),
    )
    texts = table(spark, d, "customer").select("c_custkey", text.alias("data"))
    out = parse_csv(texts, "data", ["name", "segment", "nation"], ["c_custkey"])
    return out.select(F.col("c_custkey").alias("custkey"), "record", "name", "segment", "nation",
                      F.col("extra")["3"].alias("extra"))


@query("parse_csv_malformed", """
SELECT c_custkey AS custkey, 0 AS record, c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS malformed FROM customer
UNION ALL SELECT c_custkey, 1, NULL, NULL, 'a,b"c,' || c_name || chr(10) FROM customer
UNION ALL SELECT c_custkey, 2, 'x "y"', c_name, NULL FROM customer
UNION ALL SELECT c_custkey, 3, NULL, NULL, '1,"' || c_name || '" z,3' || chr(10) FROM customer
UNION ALL SELECT c_custkey, 4, '', c_name || chr(10) || ',', NULL FROM customer
UNION ALL SELECT c_custkey, 5, NULL, NULL, 'last,"never closed' || chr(10) || c_name || ',2' || chr(10) FROM customer
""")
def _(spark, d):
    name = F.col("c_name")
    text = F.concat(
        name, F.lit(", "), F.col("c_mktsegment"), F.lit('\na,b"c,'), name, F.lit('\n"x ""y""", '), name, F.lit('\r\n1,"'), name,
        F.lit('" z,3\n\n,"'), name, F.lit('\n,"\nlast,"never closed\n'), name, F.lit(",2\n"),
    )
    texts = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), text.alias("data"))
    out = parse_csv(texts, "data", ["name", "segment"], ["custkey"], on_error="keep")
    return out.select("custkey", "record", "name", "segment", "malformed")


def _orders_xml(spark, d):
    o = table(spark, d, "orders")
    xml = F.concat(
        F.lit('<Order Status="'), F.col("o_orderstatus"), F.lit('"><Customer Code="'),
        F.col("o_custkey").cast("string"), F.lit('"/><Key>'), F.col("o_orderkey").cast("string"),
        F.lit("</Key><Tag>a</Tag><Tag>"), F.substring("o_orderpriority", 1, 1),
        F.lit("</Tag></Order>"),
    )
    return o.select("o_orderkey", xml.alias("xml"))


@query("parse_xml", """
SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS code, o_orderkey AS key,
       'a' AS tag0, substr(o_orderpriority, 1, 1) AS tag1 FROM orders
""")
def _(spark, d):
    schema = "Status string, Customer struct<Code: bigint>, Key bigint, Tag array<string>"
    out = parse_xml(_orders_xml(spark, d), "xml", "Order", schema, ["o_orderkey"])
    return out.select(
        F.col("o_orderkey").alias("id"), F.col("Order.Status").alias("status"),
        F.col("Order.Customer.Code").alias("code"), F.col("Order.Key").alias("key"),
        F.col("Order.Tag")[0].alias("tag0"), F.col("Order.Tag")[1].alias("tag1"),
    )


@query("parse_xml_variant", """
SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS code FROM orders
""")
def _(spark, d):
    out = parse_xml(_orders_xml(spark, d), "xml", "Order", keep=["o_orderkey"])
    return out.select(
        F.col("o_orderkey").alias("id"), path("Order", "$._Status").alias("status"),
        path("Order", "$.Customer._Code", "bigint").alias("code"),
    )


@query("split_frames", """
WITH c AS (SELECT user_id, event_id,
    CASE event_type WHEN 'click' THEN '{"id":' || event_id WHEN 'view' THEN ',"more":[' || event_id
         WHEN 'error' THEN 'x' || event_id || chr(13) || chr(10) || chr(10) || 'y}' || chr(10)
         WHEN 'signup' THEN chr(13) || chr(10) ELSE '}' || chr(10) END AS chunk,
    event_type NOT IN ('click', 'view') AS ends FROM events),
n AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY user_id ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frame FROM c),
w AS (SELECT user_id, frame, string_agg(chunk, '' ORDER BY event_id) AS text
      FROM n GROUP BY user_id, frame HAVING bool_or(ends)),
p AS (SELECT user_id, frame, unnest(string_split(text, chr(10))) AS piece FROM w)
SELECT user_id, CAST(frame AS BIGINT) AS frame, rtrim(piece, chr(13)) AS payload
FROM p WHERE rtrim(piece, chr(13)) <> ''
""")
def _(spark, d):
    key = F.col("event_id").cast("string")
    kind = F.col("event_type")
    chunk = (
        F.when(kind == "click", F.concat(F.lit('{"id":'), key))
        .when(kind == "view", F.concat(F.lit(',"more":['), key))
        .when(kind == "error", F.concat(F.lit("x"), key, F.lit("\r\n\ny}\n")))
        .when(kind == "signup", "\r\n")
        .otherwise("}\n")
    )
    chunks = events(spark, d).select("user_id", "event_id", chunk.alias("chunk"))
    return split_frames(chunks, "chunk", "event_id", "user_id").select(
        "user_id", "frame", "payload"
    )


@query("tick_grid", f"WITH {sql_ticks(HOUR)} SELECT p - min(p) OVER () AS since, p AS t_us FROM polls")
def _(spark, d):
    return ticks(spark, d, "1h").select((F.col("tick") * HOUR).alias("since"), us())


@query("bang", "SELECT epoch_us(max(ts)) AS t_us, '!' AS \"Bang\" FROM events")
def _(spark, d):
    return bang(events(spark, d), F.max("ts")).select(us(), "Bang")


def _captured(spark, d):
    """The pages under URLs that name the page: the table has some URLs several times, with other text."""
    pages = table(spark, d, "pages")
    return pages.withColumn("url", F.concat("url", F.lit("&page="), F.col("page_id").cast("string")))


def _requests(spark, d):
    pages = _captured(spark, d).select("page_id", "url")
    found = events(spark, d).join(pages, F.col("user_id") == F.col("page_id"))
    lost = F.concat(F.lit("http://none/"), F.col("event_id").cast("string"))
    url = F.when(F.col("event_type") == "error", lost).otherwise(F.col("url"))
    return found.select("event_id", url.alias("asked"))


@query("enrich_by_url", """
SELECT event_id, CAST(length(html) AS BIGINT) AS size, html AS data
FROM events JOIN pages ON user_id = page_id WHERE event_type <> 'error'
""")
def _(spark, d):
    out = enrich_by_url(_requests(spark, d), "asked", _captured(spark, d), body="html")
    data = path("response", "$.data")
    return out.select("event_id", F.length(data).cast("bigint").alias("size"), data.alias("data"))


@query("enrich_by_url_envelope", """
SELECT event_id, html AS body, '200 OK' AS status
FROM events JOIN pages ON user_id = page_id WHERE event_type <> 'error'
""")
def _(spark, d):
    captured = _captured(spark, d).withColumn("status", F.lit("200 OK"))
    out = enrich_by_url(_requests(spark, d), "asked", captured, "envelope", body="html")
    return out.select("event_id", path("response.body", "$").alias("body"), "response.status")
