"""Structured Streaming forms, run over all available input.

The SQL twins leave out what a stream still holds at the end of its input: windows, sessions and
held messages that are not over by the latest arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import scratch_path, use_utc, zoned
from ..streaming import (
    average_stream,
    cache_lookup_stream,
    count_stream,
    dedupe_stream,
    histogram_stream,
    is_member_stream,
    learn_stream,
    pack_by_count_stream,
    pack_by_interval_stream,
    pack_by_value_stream,
    pack_flush_stream,
    queue_stream,
    read_params,
    run_available,
    session_stream,
    sync_stream,
    timeseries_stream,
    toggle_stream,
    with_rules_stream,
    zip_clear_stream,
    zip_stream,
)
from .registry import HOUR, SQL_EVENTS, query, rounded, us

LATEST = "(SELECT max(t) FROM e)"
LATEST_MS = f"({LATEST} // 1000 * 1000)"


def file_stream(spark: SparkSession, d: str, name: str, schema: T.StructType) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    source = spark.readStream.schema(schema)
    files = spark.read.parquet(f"{d}/{name}.parquet").inputFiles()
    if any(f.rsplit("/", 2)[-2] == f"{name}.parquet" for f in files):
        return source.parquet(f"{d}/{name}.parquet")
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def stream(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    """The events table as a stream of files."""
    use_utc(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    files = file_stream(spark, d, "events", schema)
    rows = zoned(files)
    return rows.where(F.col("event_type").isin(*kinds)) if kinds else rows


@query("stream_count", f"""
WITH {SQL_EVENTS},
w AS (SELECT *, unnest(range((t + {HOUR - 1}) // {HOUR}, (t + {3 * HOUR}) // {HOUR} + 1)) * {HOUR} AS p FROM e)
SELECT p AS t_us, event_type, CAST(count(*) AS DOUBLE) AS "Count" FROM w
WHERE p + 1 <= {LATEST_MS} GROUP BY 1, 2
""")
def _(spark, d):
    out = count_stream(stream(spark, d), "3h", "1h", by=["event_type"])
    return run_available(out, "count").select(us("poll"), "event_type", "Count")


@query("stream_tumbling", f"""
WITH {SQL_EVENTS}
SELECT t // {HOUR} * {HOUR} AS t_us, count(*) AS size, min(event_id) AS first, max(event_id) AS last
FROM e WHERE t // {HOUR} * {HOUR} + {HOUR} <= {LATEST_MS} GROUP BY 1
""")
def _(spark, d):
    ids = stream(spark, d).select("ts", "event_id")
    packs = run_available(pack_by_interval_stream(ids, "1h", "ts", "event_id", parts=4), "tumbling")
    pack = F.col("Pack.event_id")
    return packs.groupBy(us("start")).agg(
        F.sum(F.size(pack)).cast("bigint").alias("size"),
        F.min(F.get(pack, F.lit(0))).alias("first"),
        F.max(F.get(pack, F.size(pack) - 1)).alias("last"),
    )


@query("stream_session", f"""
WITH {SQL_EVENTS},
g AS (SELECT *, coalesce(t - lag(t) OVER u > {6 * HOUR}, true) AS starts FROM e
      WINDOW u AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g)
SELECT user_id, min(t) AS t_us, CAST(count(*) AS DOUBLE) AS "Count" FROM s GROUP BY user_id, session
HAVING max(t) + {6 * HOUR} <= {LATEST_MS}
""")
def _(spark, d):
    out = session_stream(stream(spark, d), "user_id", "6h")
    return run_available(out, "session").select("user_id", us("session"), "Count")


@query("stream_dedupe", "SELECT DISTINCT props FROM events")
def _(spark, d):
    return run_available(dedupe_stream(stream(spark, d), "props").select("props"), "dedupe")


@query("stream_toggle", """
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 2 = 1 AS state FROM events
""")
def _(spark, d):
    return run_available(toggle_stream(stream(spark, d), "user_id", id="event_id"), "toggle")


@query("stream_pack", """
WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
           count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT CAST(user_id AS VARCHAR) AS key, pos // 3 AS number, CAST(count(*) AS BIGINT) AS size,
       min(event_id) AS first FROM n WHERE total > (pos // 3 + 1) * 3 GROUP BY 1, 2
""")
def _(spark, d):
    ids = stream(spark, d).select("user_id", "ts", "event_id")
    packs = run_available(pack_by_count_stream(ids, "user_id", 3, id="event_id"), "pack")
    first = F.get_json_object(F.get("Pack", F.lit(0)), "$.event_id").cast("bigint")
    return packs.select("key", "number", F.size("Pack").cast("bigint").alias("size"),
                        first.alias("first"))


@query("stream_queue", """
WITH x AS (SELECT *, (event_type IN ('click', 'view'))::INT AS push,
             (event_type NOT IN ('click', 'view'))::INT AS pop FROM events),
s AS (SELECT *, sum(push) OVER o AS pushes, sum(pop) OVER o AS pops FROM x
      WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, least(0, coalesce(min(pushes - pops) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s),
q AS (SELECT *, pushes - pops >= low AS served, pops + least(low, pushes - pops) AS taken FROM m)
SELECT CAST(a.user_id AS VARCHAR) AS key, a.event_id AS pop, b.event_id AS message_id
FROM q a JOIN q b ON a.user_id = b.user_id AND a.pop = 1 AND a.served AND b.push = 1
 AND b.pushes = a.taken
""")
def _(spark, d):
    out = run_available(
        queue_stream(stream(spark, d, "click", "view"),
                     stream(spark, d, "purchase", "error", "signup"), "user_id", id="event_id"),
        "queue",
    )
    return out.select("key", "pop", F.get_json_object("message", "$.event_id").cast("bigint")
                      .alias("message_id"))


@query("stream_zip", """
WITH n AS (SELECT *, event_type IN ('click', 'signup') AS is_a, row_number() OVER (
      PARTITION BY user_id, event_type IN ('click', 'signup') ORDER BY ts, event_id) - 1 AS idx FROM events)
SELECT CAST(a.user_id AS VARCHAR) AS key, a.idx, a.event_id AS a_id, b.event_id AS b_id
FROM n a JOIN n b ON a.user_id = b.user_id AND a.idx = b.idx AND a.is_a AND NOT b.is_a
""")
def _(spark, d):
    out = run_available(
        zip_stream(stream(spark, d, "click", "signup"),
                   stream(spark, d, "view", "error", "purchase"), "user_id", id="event_id"), "zip",
    )
    number = lambda c: F.get_json_object(c, "$.event_id").cast("bigint")
    return out.select("key", "idx", number("A").alias("a_id"), number("B").alias("b_id"))


@query("stream_cache", f"""
WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type IN ('click', 'view')),
l AS (SELECT event_id, user_id, ts FROM events WHERE event_type NOT IN ('click', 'view'))
SELECT l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(p.ts) <= {6 * HOUR} THEN p.value END AS value
FROM l ASOF LEFT JOIN p ON l.user_id = p.user_id AND l.ts >= p.ts
""")
def _(spark, d):
    out = run_available(
        cache_lookup_stream(stream(spark, d, "purchase", "error", "signup"),
                            stream(spark, d, "click", "view"), "user_id", "value", "6h",
                            id="event_id"), "cache",
    )
    return out.select(F.col("id").alias("event_id"), F.col("value").cast("double").alias("value"))


@query("stream_sync", f"""
WITH {SQL_EVENTS}, s AS (SELECT *, t // 1000 - (user_id % 40) * 60000 AS own FROM e),
r AS (SELECT *, own * 1000 + {10 * HOUR // 60} AS due FROM s)
SELECT event_id, greatest(due, t) AS t_us, t > due AS late FROM r
WHERE t > due OR (due + 999) // 1000 * 1000 <= {LATEST_MS} - 1000
""")
def _(spark, d):
    rows = stream(spark, d).withColumn("time", F.expr("unix_millis(ts) - (user_id % 40) * 60000"))
    out = run_available(sync_stream(rows, "user_id", "time", "10m", id="event_id"), "sync")
    return out.select(F.col("id").alias("event_id"), us("release"), "late")


@query("stream_learn", """
WITH s AS (SELECT l_quantity / 50 AS x, (l_extendedprice > 45000)::INT AS y FROM lineitem)
SELECT CAST(0 AS BIGINT) AS batch, count(*) AS n, round(-4 * avg((0.5 - y) * x) + 1e-9, 6) AS w0,
       round(-4 * avg(0.5 - y) + 1e-9, 6) AS w1 FROM s
""")
def _(spark, d):
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    files = file_stream(spark, d, "lineitem", schema)
    rows = files.select(
        (F.col("l_quantity") / 50).alias("x"), F.lit(1.0).alias("one"),
        (F.col("l_extendedprice") > 45_000).cast("double").alias("y"),
    )
    path = scratch_path(spark, "params")
    learn_stream(rows, ["x", "one"], "y", path, scratch_path(spark, "learn-check"),
                 eta=4.0).awaitTermination()
    return read_params(spark, path).select(
        "batch", F.col("rows").alias("n"), F.round(F.col("params")[0] + 1e-9, 6).alias("w0"),
        F.round(F.col("params")[1] + 1e-9, 6).alias("w1"),
    )


SQL_POLLS = f"""
w AS (SELECT *, unnest(range((t + {HOUR - 1}) // {HOUR}, (t + {{reach}}) // {HOUR} + 1)) * {HOUR} AS p FROM e)
"""


@query("stream_average", f"""
WITH {SQL_EVENTS}, {SQL_POLLS.format(reach=3 * HOUR)}
SELECT p AS t_us, event_type, round(avg(value) + 1e-9, 6) AS average FROM w WHERE p + 1 <= {LATEST_MS} GROUP BY 1, 2
""")
def _(spark, d):
    out = average_stream(stream(spark, d), "value", "3h", "1h", by=["event_type"])
    return run_available(out, "average").select(us("poll"), "event_type", rounded("Average", "average"))


@query("stream_histogram", f"""
WITH {SQL_EVENTS}, {SQL_POLLS.format(reach=4 * HOUR)}
SELECT p AS t_us, CAST(user_id AS VARCHAR) AS "Label", CAST(sum((t >= p - {3 * HOUR})::INT) AS DOUBLE) AS "Count"
FROM w WHERE p + 1 <= {LATEST_MS} GROUP BY 1, 2 HAVING sum((t >= p - {3 * HOUR} OR t <= p - {HOUR})::INT) > 0
""")
def _(spark, d):
    out = histogram_stream(stream(spark, d), "user_id", "3h", "1h")
    return run_available(out, "histogram").select(us("poll"), "Label", "Count")


@query("stream_timeseries", f"""
WITH {SQL_EVENTS},
p AS (SELECT DISTINCT user_id, (t + {6 * HOUR - 1}) // {6 * HOUR} * {6 * HOUR} AS p FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
c AS (SELECT user_id, p, count(*) AS seen FROM p JOIN e USING (user_id) WHERE t <= p GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) AS key, p AS t_us, least(seen, 3) - 1 - (seen - n) AS pos, CAST(t // 1000 AS DOUBLE) AS "timestamp", value
FROM c JOIN n USING (user_id) WHERE n BETWEEN seen - 2 AND seen AND p // 1000 <= {LATEST_MS} // 1000 - 1
""")
def _(spark, d):
    out = run_available(timeseries_stream(stream(spark, d), "user_id", "value", 3, "6h", id="event_id"), "series")
    return out.select("key", us("poll"), F.posexplode("timeseries").alias("pos", "s")).select(
        "key", "t_us", F.col("pos").cast("bigint").alias("pos"), "s.timestamp", "s.value")


@query("stream_session_pack", f"""
WITH {SQL_EVENTS},
g AS (SELECT *, coalesce(t - lag(t) OVER u > {6 * HOUR}, true) AS starts FROM e
      WINDOW u AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY t, event_id) - 1 AS pos,
      min(t) OVER (PARTITION BY user_id, session) AS first, max(t) OVER (PARTITION BY user_id, session) AS last,
      count(*) OVER (PARTITION BY user_id, session) AS total, max(session) OVER (PARTITION BY user_id) AS open FROM s)
SELECT CAST(user_id AS VARCHAR) AS key, first AS t_us, CAST(pos // 2 AS INT) AS part, CAST(count(*) AS BIGINT) AS size, min(event_id) AS first_id
FROM r WHERE session < open OR (last + {6 * HOUR}) // 1000 + 1 <= {LATEST_MS} // 1000 - 1 OR (pos // 2 + 1) * 2 < total GROUP BY 1, 2, 3
""")
def _(spark, d):
    ids = stream(spark, d).select("user_id", "ts", "event_id")
    packs = run_available(pack_by_value_stream(ids, "user_id", "6h", id="event_id", part_rows=2), "session-pack")
    first = F.get_json_object(F.get("Pack", F.lit(0)), "$.event_id").cast("bigint")
    return packs.select("key", us("session"), F.col("Part").alias("part"), F.size("Pack").cast("bigint").alias("size"), first.alias("first_id"))


@query("stream_is_member", """
WITH s AS (SELECT user_id, min(ts) AS first FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id, coalesce(first <= ts, false) AS "isMember" FROM events LEFT JOIN s USING (user_id) WHERE event_type <> 'purchase'
""")
def _(spark, d):
    probes = stream(spark, d, "click", "view", "error", "signup")
    out = run_available(is_member_stream(probes, stream(spark, d, "purchase"), "user_id", id="event_id"), "member")
    return out.select(F.col("id").alias("event_id"), "isMember")


@query("stream_zip_clear", """
WITH c AS (SELECT *, sum((event_type = 'error')::INT) OVER (ORDER BY ts, event_id) AS epoch FROM events),
n AS (SELECT *, event_type IN ('click', 'signup') AS is_a, row_number() OVER (
      PARTITION BY user_id, epoch, event_type IN ('click', 'signup') ORDER BY ts, event_id) - 1 AS idx FROM c WHERE event_type <> 'error')
SELECT CAST(a.user_id AS VARCHAR) AS key, CAST(a.epoch AS BIGINT) AS epoch, a.idx, a.event_id AS a_id, b.event_id AS b_id
FROM n a JOIN n b ON a.user_id = b.user_id AND a.epoch = b.epoch AND a.idx = b.idx AND a.is_a AND NOT b.is_a
""")
def _(spark, d):
    out = run_available(
        zip_clear_stream(stream(spark, d, "click", "signup"), stream(spark, d, "view", "purchase"), stream(spark, d, "error"),
                         "user_id", id="event_id", shards=8), "zip-clear")
    number = lambda c: F.get_json_object(c, "$.event_id").cast("bigint")
    return out.select("key", "epoch", "idx", number("A").alias("a_id"), number("B").alias("b_id"))


@query("stream_pack_flush", """
WITH c AS (SELECT *, sum((event_type = 'error')::INT) OVER (ORDER BY ts, event_id) AS epoch FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) - 1 AS pos,
      count(*) OVER (PARTITION BY user_id, epoch) AS total FROM c WHERE event_type <> 'error')
SELECT CAST(user_id AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS size, min(event_id) AS first, max(event_id) AS last
FROM n WHERE total > (pos // 2 + 1) * 2 OR epoch < (SELECT max(epoch) FROM c) GROUP BY user_id, epoch, pos // 2
""")
def _(spark, d):
    ids = stream(spark, d, "click", "view", "purchase", "signup").select("user_id", "ts", "event_id")
    packs = run_available(pack_flush_stream(ids, "user_id", 2, stream(spark, d, "error"), id="event_id", shards=8), "pack-flush")
    each = F.transform("Pack", lambda m: F.get_json_object(m, "$.event_id").cast("bigint"))
    return packs.select("key", F.size("Pack").cast("bigint").alias("size"), F.array_min(each).alias("first"), F.array_max(each).alias("last"))


@query("stream_rules", """
SELECT e.event_id, r.event_id AS rule_id, r.value AS rule_value FROM (SELECT * FROM events WHERE event_type <> 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') r ON e.ts >= r.ts
""")
def _(spark, d):
    rules = stream(spark, d, "error").select("ts", "event_id", "value")
    out = run_available(with_rules_stream(
        stream(spark, d, "click", "view", "purchase", "signup"), rules, id="event_id", shards=8), "rules")
    return out.select(
        F.col("id").alias("event_id"), F.get_json_object("rule", "$.event_id").cast("bigint").alias("rule_id"),
        F.get_json_object("rule", "$.value").cast("double").alias("rule_value"))
