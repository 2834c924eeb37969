"""Counts, histograms, averages, recent values, packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import (
    cache_snapshot,
    cardinality,
    cardinality_at,
    count_at,
    dedupe,
    histogram_at,
    histogram_changes,
    kl_divergence,
    kl_divergence_arrays,
    last_message,
    last_message_at,
    last_n,
    message_rate_at,
    moving_average_at,
    pack_by_count,
    pack_by_interval,
    pack_by_value,
    rolling_average,
    rolling_count,
    session_summary,
    timeseries_at,
)
from ..plans.tables import table
from .registry import HOUR, SQL_EVENTS, events, of_type, query, rounded, sql_ticks, ticks, us


@query("count_at", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR)}
SELECT p AS t_us, CAST(count(t) AS DOUBLE) AS "Count"
FROM polls LEFT JOIN e ON t BETWEEN p - {3 * HOUR} AND p GROUP BY p
""")
def _(spark, d):
    polls = ticks(spark, d, "1h")
    return count_at(events(spark, d), polls, "3h", "ts", "event_id").select(us(), "Count")


@query("count_at_clear", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR)},
c AS (SELECT p, max(t) AS cleared FROM polls LEFT JOIN e ON event_type = 'error' AND t <= p GROUP BY p)
SELECT p AS t_us, CAST(count(t) AS DOUBLE) AS "Count" FROM c
LEFT JOIN e ON event_type <> 'error' AND t BETWEEN p - {3 * HOUR} AND p AND t >= coalesce(cleared, 0)
GROUP BY p
""")
def _(spark, d):
    rest = of_type(spark, d, "click", "view", "purchase", "signup")
    return count_at(rest, ticks(spark, d, "1h"), "3h", "ts", "event_id",
                    clears=of_type(spark, d, "error")).select(us(), "Count")


@query("rolling_count", """
SELECT event_id, CAST(count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING
       AND CURRENT ROW) AS DOUBLE) AS "Count" FROM events
""")
def _(spark, d):
    return rolling_count(events(spark, d), "1h", "ts", "event_id").select("event_id", "Count")


@query("rolling_average", """
SELECT event_id, round(avg(value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING
       AND CURRENT ROW) + 1e-9, 6) AS average FROM events
""")
def _(spark, d):
    out = rolling_average(events(spark, d), "value", "1h", "ts", "event_id")
    return out.select("event_id", rounded("Average", "average"))


@query("moving_average_at", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR)}
SELECT p AS t_us, round(avg(value) + 1e-9, 6) AS average
FROM polls LEFT JOIN e ON t BETWEEN p - {HOUR // 4} AND p GROUP BY p
""")
def _(spark, d):
    out = moving_average_at(events(spark, d), ticks(spark, d, "1h"), "value", "15m", "ts",
                            "event_id")
    return out.select(us(), rounded("Average", "average"))


def _histogram_sql(label: str, step: int, window: int) -> str:
    return f"""
WITH {SQL_EVENTS}, {sql_ticks(step)},
l AS (SELECT {label} AS label, min(t) AS first FROM e GROUP BY 1),
live AS (SELECT p, {label} AS label, count(*) AS n FROM polls JOIN e ON t BETWEEN p - {window} AND p
         GROUP BY 1, 2)
SELECT p AS t_us, label AS "Label", CAST(coalesce(n, 0) AS DOUBLE) AS "Count"
FROM l JOIN polls ON first <= p LEFT JOIN live USING (p, label)
"""


@query("histogram_at", _histogram_sql("event_type", HOUR, HOUR))
def _(spark, d):
    out = histogram_at(events(spark, d), ticks(spark, d, "1h"), "event_type", "1h", "ts",
                       "event_id")
    return out.select(us(), F.inline("Histogram"))


@query("histogram_at_long", _histogram_sql("CAST(user_id AS VARCHAR)", 12 * HOUR, 24 * HOUR))
def _(spark, d):
    out = histogram_at(events(spark, d), ticks(spark, d, "12h"), "user_id", "24h", "ts",
                       "event_id", long=True)
    return out.select(us(), "Label", "Count")


@query("histogram_changes", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR)},
l AS (SELECT user_id, min(t) AS first FROM e GROUP BY 1),
live AS (SELECT p, user_id, count(*) AS n FROM polls JOIN e ON t BETWEEN p - {3 * HOUR} AND p GROUP BY 1, 2),
h AS (SELECT p, user_id, coalesce(n, 0) AS n, lag(coalesce(n, 0)) OVER (PARTITION BY user_id ORDER BY p) AS before
      FROM l JOIN polls ON first <= p LEFT JOIN live USING (p, user_id))
SELECT p AS t_us, CAST(user_id AS VARCHAR) AS "Label", CAST(n AS DOUBLE) AS "Count" FROM h WHERE before IS NULL OR before <> n
""")
def _(spark, d):
    out = histogram_changes(events(spark, d), ticks(spark, d, "1h"), "user_id", "3h", "ts", "event_id")
    return out.select(us(), "Label", "Count")


@query("timeseries_at", f"""
WITH {SQL_EVENTS}, {sql_ticks(6 * HOUR)},
n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n FROM e),
b AS (SELECT p, count(t) AS seen FROM polls LEFT JOIN e ON t <= p GROUP BY p),
s AS (SELECT p, seen, unnest(range(5)) AS pos FROM b)
SELECT p AS t_us, CAST(pos AS INT) AS pos, coalesce(CAST(t // 1000 AS DOUBLE), 0.0) AS "timestamp",
       coalesce(value, 0.0) AS value FROM s LEFT JOIN n ON n = seen - 4 + pos
""")
def _(spark, d):
    out = timeseries_at(events(spark, d), ticks(spark, d, "6h"), "value", 5, "ts", "event_id")
    return out.select(us(), F.posexplode("timeseries").alias("pos", "s")).select(
        "t_us", "pos", "s.timestamp", "s.value"
    )


@query("last_n", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(spark, d):
    return last_n(events(spark, d), 20, "ts", "event_id").select("event_id", "value")


@query("top_n", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10
""")
def _(spark, d):
    return last_n(table(spark, d, "orders"), 10, "o_orderdate", "o_orderkey").select(
        "o_orderkey", "o_totalprice"
    )


@query("dedupe", """
SELECT props, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY props
       ORDER BY ts, event_id) AS n FROM events) WHERE n = 1
""")
def _(spark, d):
    return dedupe(events(spark, d), "props", "ts", "event_id").select(
        "props", "event_id", "user_id"
    )


@query("cardinality", 'SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS cardinality FROM events')
def _(spark, d):
    return cardinality(events(spark, d), "user_id")


@query("cardinality_at", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR)}, f AS (SELECT props, min(t) AS t FROM e GROUP BY props)
SELECT p AS t_us, CAST(count(t) AS DOUBLE) AS cardinality FROM polls LEFT JOIN f ON t <= p GROUP BY p
""")
def _(spark, d):
    return cardinality_at(events(spark, d), ticks(spark, d, "1h"), "props").select(
        us(), "cardinality"
    )


PACKED = """
, w AS (SELECT epoch, pos // {n} AS number, min(event_id) AS first, max(event_id) AS last,
        CAST(count(*) AS BIGINT) AS size, max(total) AS total FROM n GROUP BY 1, 2)
"""


@query("pack_by_count", """
WITH n AS (SELECT 0 AS epoch, event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos,
           count(*) OVER () AS total FROM events)
""" + PACKED.format(n=7) + """
SELECT number, size, first, last FROM w WHERE total > (number + 1) * 7
""")
def _(spark, d):
    ids = events(spark, d).select("event_id", "ts")
    out = pack_by_count(ids, 7, "ts", "event_id")
    pack = F.col("Pack.event_id")
    return out.select("number", F.size("Pack").cast("bigint").alias("size"),
                      F.array_min(pack).alias("first"), F.array_max(pack).alias("last"))


@query("pack_by_count_flush", """
WITH m AS (SELECT *, sum((event_type IN ('error', 'signup'))::INT) OVER (ORDER BY ts, event_id) AS epoch
           FROM events),
n AS (SELECT epoch, event_id, row_number() OVER (PARTITION BY epoch ORDER BY ts, event_id) - 1 AS pos,
      count(*) OVER (PARTITION BY epoch) AS total FROM m WHERE event_type NOT IN ('error', 'signup'))
""" + PACKED.format(n=2) + """
, f AS (SELECT epoch - 1 AS epoch FROM m WHERE event_type = 'signup')
SELECT CAST(epoch AS BIGINT) AS epoch, number, size, first, last FROM w
WHERE total > (number + 1) * 2 OR epoch IN (SELECT epoch FROM f)
UNION ALL SELECT epoch, 0, 0, NULL, NULL FROM f WHERE epoch NOT IN (SELECT epoch FROM w)
""")
def _(spark, d):
    ids = of_type(spark, d, "click", "view", "purchase").select("event_id", "ts")
    out = pack_by_count(ids, 2, "ts", "event_id", clears=of_type(spark, d, "error"),
                        flushes=of_type(spark, d, "signup"))
    pack = F.col("Pack.event_id")
    size = F.coalesce(F.size("Pack"), F.lit(0))
    return out.select("epoch", "number", size.cast("bigint").alias("size"),
                      F.array_min(pack).alias("first"), F.array_max(pack).alias("last"))


@query("pack_by_interval", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR // 2)},
r AS (SELECT *, (row_number() OVER (PARTITION BY t // {HOUR // 2} ORDER BY t, event_id) - 1) // 5 AS part FROM e)
SELECT p AS t_us, coalesce(part, 0) AS part, CASE WHEN count(t) > 0 THEN count(t) END AS size,
       min(event_id) AS first, max(event_id) AS last
FROM polls LEFT JOIN r ON t >= p AND t < p + {HOUR // 2} GROUP BY p, 2
""")
def _(spark, d):
    ids = events(spark, d).select("event_id", "ts")
    out = pack_by_interval(ids, "30m", "ts", "event_id", ticks=ticks(spark, d, "30m"), pack_rows=5,
                           rows_per_chunk=500)
    pack = F.col("Pack.event_id")
    size = F.when(F.col("Pack").isNotNull(), F.size("Pack")).cast("bigint")
    return out.select(us("start"), F.col("Part").cast("bigint").alias("part"), size.alias("size"), F.array_min(pack).alias("first"),
                      F.array_max(pack).alias("last"))


@query("pack_by_interval_flush", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR // 2)},
m AS (SELECT *, t // {HOUR // 2} * {HOUR // 2} AS start, event_type IN ('error', 'signup') AS marker FROM e),
s AS (SELECT *, CAST(sum(marker::INT) OVER (PARTITION BY start ORDER BY t, event_id) AS BIGINT) - marker::INT AS seg FROM m),
r AS (SELECT *, (row_number() OVER (PARTITION BY start, seg ORDER BY t, event_id) - 1) // 2 AS part FROM s WHERE NOT marker),
g AS (SELECT start, seg, part, count(*) AS size, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY 1, 2, 3),
k AS (SELECT start, seg, event_type = 'signup' AS flush FROM s WHERE marker),
l AS (SELECT p AS start, count(k.start) AS seg FROM polls LEFT JOIN k ON k.start = p GROUP BY p),
x AS (SELECT start, seg FROM g UNION SELECT start, seg FROM k WHERE flush UNION SELECT start, seg FROM l)
SELECT start AS t_us, seg AS segment, coalesce(part, 0) AS part, size, first, last
FROM x LEFT JOIN g USING (start, seg) LEFT JOIN k USING (start, seg) WHERE coalesce(flush, true)
""")
def _(spark, d):
    ids = of_type(spark, d, "click", "view", "purchase").select("event_id", "ts")
    out = pack_by_interval(
        ids, "30m", "ts", "event_id", ticks=ticks(spark, d, "30m"), pack_rows=2, rows_per_chunk=500,
        clears=of_type(spark, d, "error"), flushes=of_type(spark, d, "signup"))
    pack = F.col("Pack.event_id")
    size = F.when(F.col("Pack").isNotNull(), F.size("Pack")).cast("bigint")
    return out.select(us("start"), "segment", F.col("Part").cast("bigint").alias("part"), size.alias("size"),
                      F.array_min(pack).alias("first"), F.array_max(pack).alias("last"))


SESSIONS = f"""
WITH {SQL_EVENTS},
g AS (SELECT *, coalesce(t - lag(t) OVER u > {6 * HOUR}, true) AS starts FROM e
      WINDOW u AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g)
SELECT CAST(user_id AS VARCHAR) AS reader, min(t) AS t_us, count(*) AS size, min(event_id) AS first,
       max(event_id) AS last FROM s GROUP BY user_id, session
"""
LAST_EVENT = "(SELECT max(t) FROM e)"


def _readers(spark, d):
    return events(spark, d).select(
        F.col("user_id").cast("string").alias("reader"), "ts", "event_id"
    )


@query("pack_by_value", SESSIONS.replace("SELECT CAST(user_id", """, r AS (
  SELECT *, min(t) OVER (PARTITION BY user_id, session) AS begin,
         (row_number() OVER (PARTITION BY user_id, session ORDER BY t, event_id) - 1) // 2 AS part FROM s)
SELECT CAST(user_id""").replace("min(t) AS t_us", "begin AS t_us, part").replace(
    "FROM s GROUP BY user_id, session", "FROM r GROUP BY user_id, begin, part"))
def _(spark, d):
    out = pack_by_value(_readers(spark, d), "reader", "6h", "ts", "event_id", pack_rows=2,
                        rows_per_chunk=500)
    pack = F.col("Pack.event_id")
    return out.select(
        "reader", us("session"), F.col("Part").cast("bigint").alias("part"),
        F.size("Pack").cast("bigint").alias("size"), F.array_min(pack).alias("first"), F.array_max(pack).alias("last"),
    )


@query("session_summary", SESSIONS.replace(
    "AS size, min(event_id) AS first,\n       max(event_id) AS last FROM s",
    "AS size FROM s") + f" HAVING max(t) + {6 * HOUR} < epoch_us(TIMESTAMP '2024-01-29')")
def _(spark, d):
    end = F.lit("2024-01-29 00:00:00").cast("timestamp")
    out = session_summary(_readers(spark, d), "reader", "6h", "ts", "event_id", as_of=end)
    return out.select("reader", us("session"), F.col("Count").cast("bigint").alias("size"))


@query("cache_snapshot", f"""
WITH p AS (SELECT user_id, arg_max(value, ts) AS value, max(epoch_us(ts)) AS put_us FROM events
           WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT user_id AS key, value FROM p WHERE epoch_us(TIMESTAMP '2024-01-20') - put_us <= {12 * HOUR}
""")
def _(spark, d):
    return cache_snapshot(events(spark, d), "user_id", "value", "2024-01-20 00:00:00", "12h",
                          "ts", "event_id")


KL = """
a AS (SELECT *, CAST(p AS DOUBLE) / sum(p) OVER (PARTITION BY user_id) AS pn,
             CAST(q AS DOUBLE) / sum(q) OVER (PARTITION BY user_id) AS qn FROM h),
b AS (SELECT user_id, coalesce(pn, 0.0001) AS pn, coalesce(qn, 0.0001) AS qn FROM a
      WHERE user_id IN (SELECT user_id FROM h WHERE p IS NOT NULL)
        AND user_id IN (SELECT user_id FROM h WHERE q IS NOT NULL)),
c AS (SELECT user_id, pn / sum(pn) OVER (PARTITION BY user_id) AS p,
             qn / sum(qn) OVER (PARTITION BY user_id) AS q FROM b)
"""


@query("kl_divergence", """
WITH s AS (SELECT user_id, event_type, ts < TIMESTAMP '2024-01-15' AS early FROM events),
h AS (SELECT user_id, event_type, CAST(nullif(count(*) FILTER (early), 0) AS DOUBLE) AS p,
      CAST(nullif(count(*) FILTER (NOT early), 0) AS DOUBLE) AS q FROM s GROUP BY 1, 2),
""" + KL + 'SELECT user_id, round(sum(p * ln(p / q)) + 1e-9, 6) AS kl FROM c GROUP BY user_id')
def _(spark, d):
    e, cut = events(spark, d), F.lit("2024-01-15").cast("timestamp")
    counts = lambda cond: e.where(cond).groupBy(
        "user_id", F.col("event_type").alias("Label")
    ).agg(F.count(F.lit(1)).cast("double").alias("Count"))
    out = kl_divergence(counts(F.col("ts") < cut), counts(F.col("ts") >= cut), ["user_id"])
    return out.select("user_id", rounded("KL", "kl"))


@query("kl_divergence_arrays", f"""
WITH {SQL_EVENTS}, {sql_ticks(24 * HOUR)},
l AS (SELECT event_type, min(t) AS first FROM e GROUP BY 1),
h AS (SELECT polls.p AS user_id, l.event_type,
      greatest(CAST(count(t) FILTER (t >= polls.p - {6 * HOUR}) AS DOUBLE), 0.0001) AS p,
      greatest(CAST(count(t) AS DOUBLE), 0.0001) AS q
      FROM l JOIN polls ON first <= p
      LEFT JOIN e ON l.event_type = e.event_type AND t BETWEEN polls.p - {72 * HOUR} AND polls.p
      GROUP BY polls.p, l.event_type),
{KL} SELECT user_id AS t_us, round(sum(p * ln(p / q)) + 1e-9, 6) AS kl FROM c GROUP BY user_id
""")
def _(spark, d):
    """How far the last six hours differ from the last three days, every day."""
    e, polls = events(spark, d), ticks(spark, d, "24h")
    now = histogram_at(e, polls, "event_type", "6h", "ts", "event_id")
    base = histogram_at(e, polls, "event_type", "72h", "ts", "event_id")
    both = now.withColumnRenamed("Histogram", "now").join(
        base.select("tick", F.col("Histogram").alias("base")), "tick"
    )
    return kl_divergence_arrays(both, "now", "base", "tick").select(us(), rounded("KL", "kl"))


@query("message_rate_at", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR)}, n AS (SELECT t, row_number() OVER (ORDER BY ts, event_id) AS n FROM e),
b AS (SELECT p, count(t) AS seen FROM polls LEFT JOIN e ON t <= p GROUP BY p)
SELECT p AS t_us, CASE WHEN seen = 0 THEN 0.0
       ELSE round(1e6 * least(seen, 100) / (p - t) + 1e-9, 6) END AS rate
FROM b LEFT JOIN n ON n = seen - least(seen, 100) + 1
""")
def _(spark, d):
    out = message_rate_at(events(spark, d), ticks(spark, d, "1h"), 100, "ts", "event_id")
    rate = F.when(F.col("Rate") == 0, 0.0).otherwise(rounded("Rate", "r"))
    return out.select(us(), rate.alias("rate"))


@query("last_message", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def _(spark, d):
    return last_message(events(spark, d), "ts", "event_id").select("event_id")


@query("last_message_at", f"""
WITH {SQL_EVENTS}, {sql_ticks(HOUR)}
SELECT p AS t_us, event_id, value FROM polls ASOF LEFT JOIN e ON p >= t
""")
def _(spark, d):
    out = last_message_at(events(spark, d), ticks(spark, d, "1h"), "ts", "event_id")
    return out.select(us(), "Last.event_id", "Last.value")
