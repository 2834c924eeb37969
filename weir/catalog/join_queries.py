"""Positional joins, membership, cache, merging and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import (
    cache_lookup,
    cache_lookup_keys,
    drop_members,
    is_member,
    keep_members,
    merge,
    with_rules,
    zip_join,
)
from ..plans.tables import table
from .registry import HOUR, events, of_type, query


@query("zip_join", """
WITH a AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events
           WHERE event_type IN ('click', 'signup')),
b AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events
      WHERE event_type NOT IN ('click', 'signup'))
SELECT a.n - 1 AS idx, a.event_id AS a_id, b.event_id AS b_id FROM a JOIN b USING (n)
""")
def _(spark, d):
    out = zip_join(of_type(spark, d, "click", "signup"),
                   of_type(spark, d, "view", "error", "purchase"), "ts", "event_id")
    return out.select("idx", F.col("A.event_id").alias("a_id"), F.col("B.event_id").alias("b_id"))


@query("zip_join_clear", """
WITH e AS (SELECT *, sum((event_type = 'error')::INT) OVER (ORDER BY ts, event_id) AS epoch FROM events),
n AS (SELECT *, event_type IN ('click', 'signup') AS is_a,
      row_number() OVER (PARTITION BY epoch, event_type IN ('click', 'signup')
                         ORDER BY ts, event_id) - 1 AS idx FROM e WHERE event_type <> 'error')
SELECT CAST(a.epoch AS BIGINT) AS epoch, a.idx, a.event_id AS a_id, b.event_id AS b_id
FROM n a JOIN n b ON a.epoch = b.epoch AND a.idx = b.idx AND a.is_a AND NOT b.is_a
""")
def _(spark, d):
    out = zip_join(
        of_type(spark, d, "click", "signup"), of_type(spark, d, "view", "purchase"), "ts",
        "event_id", clears=of_type(spark, d, "error"),
    )
    return out.select("epoch", "idx", F.col("A.event_id").alias("a_id"),
                      F.col("B.event_id").alias("b_id"))


MEMBERS = """
WITH s AS (SELECT user_id, min(ts) AS first FROM events WHERE event_type = 'purchase' GROUP BY 1)
"""


@query("is_member", MEMBERS + """
SELECT event_id, coalesce(first <= ts, false) AS "isMember" FROM events LEFT JOIN s USING (user_id)
""")
def _(spark, d):
    return is_member(events(spark, d), of_type(spark, d, "purchase"), "user_id").select(
        "event_id", "isMember"
    )


@query("keep_members", MEMBERS + """
SELECT event_id FROM events JOIN s USING (user_id) WHERE first <= ts
""")
def _(spark, d):
    buyers = of_type(spark, d, "purchase")
    return keep_members(events(spark, d), buyers, "user_id", "ts").select("event_id")


@query("keep_members_timeless", """
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events)
""")
def _(spark, d):
    return keep_members(
        table(spark, d, "orders"), events(spark, d), "o_custkey", add_key="user_id"
    ).select("o_orderkey")


@query("drop_members", """
SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)
""")
def _(spark, d):
    return drop_members(
        table(spark, d, "orders"), events(spark, d), "o_custkey", add_key="user_id"
    ).select("o_orderkey")


@query("cache_lookup", f"""
WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type IN ('click', 'view')),
l AS (SELECT event_id, user_id, ts FROM events WHERE event_type NOT IN ('click', 'view'))
SELECT l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(p.ts) <= {6 * HOUR} THEN p.value END AS value
FROM l ASOF LEFT JOIN p ON l.user_id = p.user_id AND l.ts >= p.ts
""")
def _(spark, d):
    lookups = of_type(spark, d, "purchase", "error", "signup").select("event_id", "user_id", "ts")
    out = cache_lookup(lookups, of_type(spark, d, "click", "view"), "user_id", "value", "6h",
                       "ts", "event_id")
    return out.select("event_id", "value")


@query("cache_lookup_keys", f"""
WITH p AS (SELECT user_id, arg_max(value, ts) AS v, max(epoch_us(ts)) AS put_us FROM events
           WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT c_custkey AS key, CASE WHEN epoch_us(TIMESTAMP '2024-01-20') - put_us <= {24 * HOUR} THEN v END AS value
FROM customer LEFT JOIN p ON c_custkey = user_id
""")
def _(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return cache_lookup_keys(events(spark, d), keys, "user_id", "value",
                             "2024-01-20 00:00:00", "24h", "ts", "event_id")


@query("merge", """
SELECT o_custkey AS id, o_totalprice AS amount, NULL AS kind FROM orders
UNION ALL SELECT user_id, value, event_type FROM events
""")
def _(spark, d):
    return merge(
        table(spark, d, "orders").select(F.col("o_custkey").alias("id"),
                                         F.col("o_totalprice").alias("amount")),
        events(spark, d).select(F.col("user_id").alias("id"), F.col("value").alias("amount"),
                                F.col("event_type").alias("kind")),
    )


@query("with_rules", """
WITH r AS (SELECT ts, value AS bar FROM events WHERE event_type = 'signup')
SELECT event_id, r.bar AS limit_value, coalesce(value > r.bar, false) AS above
FROM (SELECT * FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN r ON e.ts >= r.ts
""")
def _(spark, d):
    rules = of_type(spark, d, "signup").select(
        "ts", "event_id", F.col("value").alias("limit_value")
    )
    rest = of_type(spark, d, "click", "view", "purchase", "error")
    out = with_rules(rest, rules, "ts", "event_id", "ts", "event_id")
    above = F.coalesce(F.col("value") > F.col("limit_value"), F.lit(False))
    return out.select("event_id", "limit_value", above.alias("above"))
