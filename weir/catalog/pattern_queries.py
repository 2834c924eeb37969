"""Whole message patterns, made of several operators each."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import (
    cache_snapshot,
    count_at,
    enrich_by_url,
    every_nth,
    exists_key,
    filter_messages,
    fire_at_ticks,
    histogram_at,
    is_member,
    kl_divergence,
    learn_linear,
    linear_model,
    map_messages,
    mask,
    moving_average_at,
    num,
    parse_xml,
    path,
    ticks_over,
    timeseries_at,
    unpack,
    with_gaussian,
    with_poisson,
    with_zipf,
    zip_join,
)
from ..plans.lookups import lookup_join
from ..plans.ordering import with_index
from ..plans.tables import table
from .registry import HOUR, SQL_EVENTS, events, of_type, query, rounded, sql_ticks, ticks, us


@query("c1_edits", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR)},
f AS (SELECT * FROM e WHERE event_type <> 'error' AND value > 10 AND user_id <> 1),
l AS (SELECT event_type, min(t) AS first FROM f GROUP BY 1),
n AS (SELECT p, event_type, count(*) AS n FROM polls JOIN f ON t BETWEEN p - {HOUR} AND p GROUP BY 1, 2)
SELECT p AS t_us, event_type AS "Label", CAST(coalesce(n, 0) AS DOUBLE) AS "Count"
FROM l JOIN polls ON first <= p LEFT JOIN n USING (p, event_type)
""")
def _(spark, d):
    """Filters, a mask, and the types of the last hour at every hour."""
    kept = filter_messages(events(spark, d), "event_type <> 'error'")
    kept = filter_messages(filter_messages(kept, "value > 10"), "user_id <> 1")
    kept = mask(kept, {"event_id": {}, "ts": {}, "event_type": {}})
    out = histogram_at(kept, ticks(spark, d, "1h"), "event_type", "1h", "ts", "event_id")
    return out.select(us(), F.inline("Histogram"))


@query("c2_clicks_series", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR)},
c AS (SELECT p, CAST(count(t) AS DOUBLE) AS n FROM polls LEFT JOIN e ON t BETWEEN p - {HOUR} AND p GROUP BY p),
r AS (SELECT p, n, row_number() OVER (ORDER BY p DESC) AS k FROM c)
SELECT CAST(20 - k AS INT) AS pos, CAST(p // 1000 AS DOUBLE) AS "timestamp", n AS value FROM r WHERE k <= 20
""")
def _(spark, d):
    """The count of the last hour, polled every hour, as a series of the last 20 counts."""
    polls = ticks(spark, d, "1h")
    counts = count_at(events(spark, d), polls, "1h", "ts", "event_id")
    end = polls.agg(F.max("ts").alias("ts"))
    out = timeseries_at(counts, end, "Count", 20, "ts", "tick")
    return out.select(F.posexplode("timeseries").alias("pos", "s")).select(
        "pos", "s.timestamp", "s.value"
    )


@query("c3_fire_every_fifth", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events
                      WHERE event_type = 'click') WHERE n % 5 = 0
""")
def _(spark, d):
    return every_nth(of_type(spark, d, "click"), 5, "ts", "event_id").select("event_id")


@query("c3_integrate_and_fire")
def _(spark, d):
    """Per type: polled every ten minutes; three or more messages of the last hour fire and clear."""
    out = fire_at_ticks(events(spark, d), "event_type", 3, "10m", "1h")
    return out.select("key", us("at"), "Count")


@query("c4_check_join_filter", """
WITH s AS (SELECT user_id, min(ts) AS first FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT event_id FROM events JOIN s USING (user_id) WHERE event_type = 'view' AND first <= ts
""")
def _(spark, d):
    """Ask the set for every message, zip the answers with the messages, keep the members. The
    join is cleared every six hours, which loses nothing as both sides are complete then."""
    views = of_type(spark, d, "view").select("event_id", "ts", "user_id")
    answers = is_member(views, of_type(spark, d, "signup"), "user_id").select(
        "event_id", "ts", "isMember"
    )
    out = zip_join(views, answers, "ts", "event_id", clears=ticks(spark, d, "6h"))
    return filter_messages(out, "B.isMember").select("A.event_id")


def _order_pages(spark, d):
    """A captured response per order: its lines as JSON."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(
        F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"),
                 F.col("l_quantity").alias("quantity"))).alias("lines"))
    return lines.select(
        F.concat(F.lit("http://shop/"), F.col("l_orderkey").cast("string")).alias("url"),
        F.to_json(F.struct("l_orderkey", "lines")).alias("body"),
    )


def _order_lines(spark, d):
    asked = map_messages(
        table(spark, d, "orders"), {"asked": "concat('http://shop/', o_orderkey)"}, False
    )
    got = enrich_by_url(asked, "asked", _order_pages(spark, d))
    kind = "array<struct<line:int,flag:string,quantity:double>>"
    lines = path("response", "$.lines", kind)
    order = path("response", "$.l_orderkey", "bigint")
    return got.select(order.alias("order_key"), lines.alias("lines"))


@query("c5_stations", """
SELECT l_orderkey AS order_key, l_linenumber AS line, l_quantity AS quantity
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'
""")
def _(spark, d):
    """Get the response of every URL, unpack its array, keep some of the elements."""
    out = unpack(_order_lines(spark, d), "lines", label="order_key")
    return filter_messages(out, "Value.flag = 'R'").select(
        F.col("Label").alias("order_key"), "Value.line", "Value.quantity"
    )


MONTH = 30 * 24 * HOUR


def _vote_sql(col: str) -> str:
    return f"""
WITH e AS (SELECT {col} AS label, epoch_us(l_shipdate) AS t FROM lineitem),
lim AS (SELECT min(t) AS a, max(t) AS b FROM e),
polls AS (SELECT unnest(range(a // {MONTH}, (b + {MONTH - 1}) // {MONTH} + 1)) * {MONTH} AS p FROM lim),
l AS (SELECT label, min(t) AS first FROM e GROUP BY 1),
d AS (SELECT label, t, count(*) AS n FROM e GROUP BY 1, 2),
n AS (SELECT p, label, sum(n) AS n FROM polls JOIN d ON t BETWEEN p - {3 * MONTH} AND p GROUP BY 1, 2)
SELECT p AS t_us, label AS "Label", CAST(coalesce(n, 0) AS DOUBLE) AS "Count"
FROM l JOIN polls ON first <= p LEFT JOIN n USING (p, label)
"""


def _votes(spark, d, key):
    line = F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate",
                    "l_quantity")
    packs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(line).alias("results"))
    votes = mask(unpack(packs, "results"),
                 {"l_orderkey": {}, "l_linenumber": {}, key: {}, "l_shipdate": {}})
    votes = votes.withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    polls = ticks_over(table(spark, d, "lineitem"), "720h", "l_shipdate")
    out = histogram_at(votes, polls, key, "2160h", "l_shipdate", "id", long=True)
    return out.select(us(), "Label", "Count")


@query("c6_votes_by_result", _vote_sql("l_returnflag"))
def _(spark, d):
    return _votes(spark, d, "l_returnflag")


@query("c6_votes_by_chamber", _vote_sql("l_linestatus"))
def _(spark, d):
    return _votes(spark, d, "l_linestatus")


@query("c7_quakes", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR)}
SELECT p AS t_us, CAST(count(t) AS DOUBLE) AS "Count"
FROM polls LEFT JOIN e ON event_type = 'click' AND t BETWEEN p - {HOUR} AND p GROUP BY p
""")
def _(spark, d):
    """JSON messages with an array of features; unpack, keep one type, count."""
    feature = F.struct(F.struct(F.col("event_type").alias("type"), F.col("value").alias("mag"))
                       .alias("properties"), "event_id", "ts")
    feeds = events(spark, d).groupBy(F.window("ts", "1 hour")).agg(
        F.to_json(F.struct(F.collect_list(feature).alias("features"))).alias("body"))
    schema = ("features array<struct<properties: struct<type: string, mag: double>, "
              "event_id: bigint, ts: timestamp>>")
    features = unpack(feeds.select(F.from_json("body", schema, {
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"}).alias("m")).select("m.*"),
        "features")
    ids = events(spark, d).select("event_id", F.col("ts").alias("at"))
    exact = filter_messages(features, "properties.type = 'click'").join(ids, "event_id")
    return count_at(exact, ticks(spark, d, "1h"), "1h", "at", "event_id", "ts").select(us(), "Count")


@query("c8_quake_maps", """
SELECT event_id, page_id AS shake, 'p' || page_id AS id FROM events JOIN pages ON page_id = user_id
WHERE event_type <> 'error' AND page_id % 3 <> 0
""")
def _(spark, d):
    """Follow a detail URL where there is one, and map a bracketed path where it exists.

    A detail URL names its page: the table has some URLs several times.
    """
    text = F.col("page_id").cast("string")
    pages = table(spark, d, "pages").select("page_id", F.concat("url", F.lit("&page="), text).alias("url"))
    product = F.when(F.col("page_id") % 3 == 0, '{"other":1}').otherwise(
        F.concat(F.lit('{"shake/map.jpg":[0,'), text, F.lit("]}")))
    details = pages.select("url", F.concat(
        F.lit('{"id":"p'), text, F.lit('","contents":'), product, F.lit("}")).alias("body"))
    feed = events(spark, d).join(pages, F.col("user_id") == F.col("page_id")).select(
        "event_id",
        F.when(F.col("event_type") == "error", F.to_json(F.struct("event_id"))).otherwise(
            F.to_json(F.struct("event_id", F.col("url").alias("detail")))).alias("body"))
    with_detail = filter_messages(feed, exists_key("body", "detail")).select(
        "event_id", F.get_json_object("body", "$.detail").alias("detail"))
    got = enrich_by_url(with_detail, "detail", details)
    contents = path("response", "$.contents", "variant")
    mapped = filter_messages(got, exists_key(contents, "shake/map.jpg", "variant"))
    return map_messages(mapped, {
        "event_id": F.col("event_id"), "id": path("response", "$.id"),
        "shake": path("response", "$.contents['shake/map.jpg'][1]", "bigint"),
    }, additive=False)


@query("c9_lost_property", """
WITH l AS (SELECT l_orderkey, l_returnflag || '-' || l_linestatus AS sub,
           CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT sub, arg_max(n, l_orderkey) AS n, max(l_orderkey) AS k FROM l GROUP BY 1)
SELECT sub AS key, CAST(n AS DOUBLE) AS value FROM c
""")
def _(spark, d):
    """XML reports with categories and sub-categories: unpack twice, and keep the latest number
    per sub-category. The order key stands for the time."""
    sub = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("bigint").alias("n"))
    tag = F.concat(F.lit('<SubCategory SubCategory="'), F.col("l_returnflag"), F.lit("-"),
                   F.col("l_linestatus"), F.lit('" count="'), F.col("n").cast("string"), F.lit('"/>'))
    category = sub.groupBy("l_orderkey", "l_returnflag").agg(F.concat(
        F.lit("<Category>"), F.array_join(F.collect_list(tag), ""), F.lit("</Category>")).alias("c"))
    reports = category.groupBy("l_orderkey").agg(F.concat(
        F.lit("<LostProperty>"), F.array_join(F.collect_list("c"), ""),
        F.lit("</LostProperty>")).alias("xml"))
    schema = ("Category array<struct<SubCategory: "
              "array<struct<SubCategory: string, count: string>>>>")
    parsed = parse_xml(reports, "xml", "LostProperty", schema, ["l_orderkey"])
    categories = unpack(parsed.select("l_orderkey", F.col("LostProperty.Category").alias("c")),
                        "c", "l_orderkey")
    subs = unpack(categories.select("Label", F.col("Value.SubCategory").alias("s")), "s", "Label")
    puts = subs.select(
        F.col("Value.SubCategory").alias("key_"), num("Value.count").alias("n"),
        F.col("Label").alias("id"), F.timestamp_seconds("Label").alias("ts"))
    return cache_snapshot(puts, "key_", "n", "2100-01-01 00:00:00", "2000000h")


@query("c10_crowd_vote", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR // 2)}
SELECT p AS t_us, round(avg(value) + 1e-9, 6) AS average
FROM polls LEFT JOIN e ON t BETWEEN p - {2 * HOUR} AND p GROUP BY p
""")
def _(spark, d):
    out = moving_average_at(events(spark, d), ticks(spark, d, "30m"), "value", "2h", "ts", "event_id")
    return out.select(us(), rounded("Average", "average"))


@query("c11_random_numbers")
def _(spark, d):
    grid = ticks(spark, d, "1m").select(F.col("tick").alias("id"), "ts")
    grid = with_zipf(grid).withColumnRenamed("sample", "zipf")
    grid = with_poisson(grid, rate=3.0).withColumnRenamed("sample", "poisson")
    return with_gaussian(grid).withColumnRenamed("sample", "gaussian").select(
        us(), "zipf", "poisson", "gaussian")


@query("c12_poller", f"""
WITH {sql_ticks(HOUR)}, g AS (SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS place, count(*) OVER () AS n FROM pages),
t AS (SELECT p, (p - min(p) OVER ()) // {HOUR} AS tick FROM polls),
u AS (SELECT url, arg_max(html, page_id) AS html FROM pages GROUP BY url)
SELECT p AS t_us, url, u.html AS body FROM t JOIN g ON place = tick % n JOIN u USING (url)
""")
def _(spark, d):
    """Every tick asks for the URL of the next page, and begins again after the last."""
    pages = table(spark, d, "pages")
    n = pages.count()
    places = with_index(pages.select("page_id", "url"), ["page_id"], "place").select("place", F.col("url").alias("asked"))
    turns = map_messages(ticks(spark, d, "1h"), {"turn": F.col("tick") % max(n, 1)})
    asked = lookup_join(turns, places, ["turn"], ["place"], "inner")
    got = enrich_by_url(asked, "asked", pages, body="html", order="page_id")
    return got.select(us(), F.col("asked").alias("url"), path("response", "$.data").alias("body"))


@query("c13_histogram_drift", f"""
WITH {SQL_EVENTS}, {sql_ticks(24 * HOUR)},
l AS (SELECT event_type, min(t) AS first FROM e GROUP BY 1),
h AS (SELECT polls.p AS day, l.event_type,
      greatest(CAST(count(t) FILTER (t >= polls.p - {24 * HOUR}) AS DOUBLE), 0.0001) AS p,
      greatest(CAST(count(t) AS DOUBLE), 0.0001) AS q FROM l JOIN polls ON first <= p
      LEFT JOIN e ON l.event_type = e.event_type AND t BETWEEN polls.p - {168 * HOUR} AND polls.p
      GROUP BY polls.p, l.event_type),
n AS (SELECT day, p / sum(p) OVER (PARTITION BY day) AS p, q / sum(q) OVER (PARTITION BY day) AS q FROM h)
SELECT day AS t_us, round(sum(p * ln(p / q)) + 1e-9, 6) AS kl FROM n GROUP BY day
""")
def _(spark, d):
    """How far the last day differs from the last week, every day."""
    e, polls = events(spark, d), ticks(spark, d, "24h")
    live = lambda w: histogram_at(e, polls, "event_type", w, "ts", "event_id", long=True)
    out = kl_divergence(live("24h"), live("168h"), ["ts"])
    return out.select(us(), rounded("KL", "kl"))


@query("c14_train_and_score", """
WITH w AS (SELECT sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_quantity * w + 1e-9, 4) AS response FROM lineitem, w
""")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    weights = learn_linear(lines, ["l_quantity"], "l_extendedprice").first()["params"]
    out = linear_model(lines, ["l_quantity"], list(weights))
    return out.select("l_orderkey", "l_linenumber", rounded("Response", "response", 4))
