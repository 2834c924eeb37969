"""Re-ordering, queues, models, random columns and sinks."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import (
    batch_payloads,
    bulk_docs,
    every_nth,
    learn,
    learn_at,
    learn_linear,
    linear_model,
    logistic_model,
    queue_peek,
    queue_pops,
    sync,
    toggle,
    with_categorical,
    with_exponential,
    with_gaussian,
    with_poisson,
    with_zipf,
    write_messages,
)
from ..plans.tables import scratch_path, table
from .registry import HOUR, SQL_EVENTS, events, of_type, query, rounded, sql_ticks, ticks, us


@query("sync", f"""
WITH {SQL_EVENTS}, s AS (SELECT event_id, t, t // 1000 - (user_id % 40) * 60000 AS own FROM e
                         WHERE event_type <> 'error'),
r AS (SELECT *, greatest(own * 1000 + {10 * HOUR // 60}, t) AS release FROM s)
SELECT event_id, release AS t_us, t > own * 1000 + {10 * HOUR // 60} AS late,
       row_number() OVER (ORDER BY release, own, event_id) - 1 AS pos FROM r
""")
def _(spark, d):
    own = F.expr("unix_millis(ts) - (user_id % 40) * 60000").cast("string")
    rows = events(spark, d).withColumn(
        "time", F.when(F.col("event_type") == "error", "n/a").otherwise(own)
    )
    out = sync(rows, "time", "10m", "ts", "event_id", positions=True)
    return out.select("event_id", us("release"), "late", "pos")


# A pop is served when the running sum of pushes and pops does not fall below its earlier lowest
# value (or 0).
QUEUE = f"""
WITH {SQL_EVENTS},
x AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS push,
             CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN 1 ELSE 0 END AS pop FROM e),
s AS (SELECT *, sum(push) OVER o AS pushes, sum(pop) OVER o AS pops FROM x
      WINDOW o AS (ORDER BY t, event_id)),
m AS (SELECT *, least(0, coalesce(min(pushes - pops) OVER (ORDER BY t, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s),
q AS (SELECT *, pushes - pops >= low AS served, pops + least(low, pushes - pops) AS taken FROM m)
"""


@query("queue_pops", QUEUE + """
SELECT CAST(a.taken - 1 AS BIGINT) AS k, a.event_id AS pop_id, b.event_id AS message_id
FROM q a JOIN q b ON a.pop = 1 AND a.served AND b.push = 1 AND b.pushes = a.taken
""")
def _(spark, d):
    out = queue_pops(of_type(spark, d, "click", "view"),
                     of_type(spark, d, "purchase", "error", "signup"), "ts", "event_id")
    return out.select("k", F.col("pop.event_id").alias("pop_id"),
                      F.col("message.event_id").alias("message_id"))


@query("queue_peek", QUEUE + f""", {sql_ticks(HOUR)},
l AS (SELECT p, pushes, taken FROM polls ASOF LEFT JOIN q ON p >= t)
SELECT p AS t_us, b.event_id AS message_id FROM l
LEFT JOIN q b ON b.push = 1 AND l.pushes > l.taken AND b.pushes = l.taken + 1
""")
def _(spark, d):
    out = queue_peek(of_type(spark, d, "click", "view"),
                     of_type(spark, d, "purchase", "error", "signup"), ticks(spark, d, "1h"),
                     "ts", "event_id")
    return out.select(us(), F.col("message.event_id").alias("message_id"))


@query("toggle", """
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) % 2 = 1 AS state FROM events
""")
def _(spark, d):
    return toggle(events(spark, d), "ts", "event_id").select("event_id", "state")


@query("every_nth", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events)
WHERE n % 5 = 0
""")
def _(spark, d):
    return every_nth(events(spark, d), 5, "ts", "event_id").select("event_id")


@query("linear_model", """
SELECT l_orderkey, l_linenumber, round(0.5 * l_quantity - 2 * l_discount + 0.001 * l_extendedprice + 1e-9, 6)
       AS response FROM lineitem
""")
def _(spark, d):
    out = linear_model(table(spark, d, "lineitem"),
                       ["l_quantity", "l_discount", "l_extendedprice"], [0.5, -2.0, 0.001])
    return out.select("l_orderkey", "l_linenumber", rounded("Response", "response"))


@query("logistic_probability", """
SELECT l_orderkey, l_linenumber,
       round(1 / (1 + exp(-(0.05 * l_quantity - 20 * l_discount))) + 1e-9, 6) AS response FROM lineitem
""")
def _(spark, d):
    out = logistic_model(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], [0.05, -20.0],
                         mode="probability")
    return out.select("l_orderkey", "l_linenumber", rounded("Response", "response"))


@query("logistic_draw", "SELECT true AS near_mean, true AS is_binary")
def _(spark, d):
    """The draws have the mean that their probabilities say, within six standard errors."""
    e = events(spark, d).withColumn("scaled", F.col("value") / 100)
    args = (["scaled"], [0.7])
    drawn = logistic_model(e, *args, id="event_id").select("event_id", F.col("Response").alias("y"))
    p = logistic_model(e, *args, mode="probability").select(
        "event_id", F.col("Response").alias("p")
    )
    t = drawn.join(p, "event_id").agg(
        F.sum(F.col("y") - F.col("p")).alias("off"),
        F.sum(F.col("p") * (1 - F.col("p"))).alias("var"),
        F.bool_and(F.col("y").isin(0.0, 1.0)).alias("is_binary"),
    )
    return t.select((F.abs("off") <= 6 * F.sqrt("var")).alias("near_mean"), "is_binary")


@query("learn_at", f"""
WITH {SQL_EVENTS}, {sql_ticks(6 * HOUR)},
m AS (SELECT p, count(t) AS n, sum(CAST(user_id AS DOUBLE) * user_id) AS xx, sum(CAST(user_id AS DOUBLE)) AS x,
  sum(user_id * value) AS xy, sum(value) AS y FROM polls LEFT JOIN e ON t <= p GROUP BY p)
SELECT p AS t_us, CASE WHEN n * xx - x * x > 1e-9 * n * xx THEN round((n * xy - x * y) / (n * xx - x * x) + 1e-9, 5) + 0.0 END AS slope,
  CASE WHEN n * xx - x * x > 1e-9 * n * xx THEN round((xx * y - x * xy) / (n * xx - x * x) + 1e-9, 5) END AS intercept FROM m
""")
def _(spark, d):
    out = learn_at(events(spark, d), ticks(spark, d, "6h"), ["user_id", F.lit(1.0)], "value", "ts", "event_id")
    slope, intercept = F.get("params", F.lit(0)), F.get("params", F.lit(1))
    return out.select(us(), (rounded(slope, "slope", 5) + 0.0).alias("slope"), rounded(intercept, "intercept", 5))


@query("learn_linear", """
WITH s AS (SELECT sum(l_quantity * l_quantity) AS aa, sum(l_quantity * l_discount) AS ab,
                  sum(l_discount * l_discount) AS bb, sum(l_quantity * l_extendedprice) AS ay,
                  sum(l_discount * l_extendedprice) AS by_ FROM lineitem)
SELECT round((ay * bb - by_ * ab) / (aa * bb - ab * ab), 3) AS w0,
       round((by_ * aa - ay * ab) / (aa * bb - ab * ab), 3) AS w1 FROM s
""")
def _(spark, d):
    out = learn_linear(table(spark, d, "lineitem"), ["l_quantity", "l_discount"],
                       "l_extendedprice")
    return out.select(F.round(F.col("params")[0], 3).alias("w0"),
                      F.round(F.col("params")[1], 3).alias("w1"))


def _descent_sql(steps: int, eta: float) -> str:
    """Gradient steps as a chain of aggregates."""
    error = "1 / (1 + exp(-(w0 * x + w1))) - y"
    chain = "".join(
        f", p{i + 1} AS (SELECT w0 - {eta} * avg(({error}) * x) AS w0, w1 - {eta} * avg({error}) AS w1 "
        f"FROM s, p{i} GROUP BY w0, w1)" for i in range(steps)
    )
    return f"""
WITH s AS (SELECT l_quantity / 50 AS x, (l_extendedprice > 45000)::INT AS y FROM lineitem),
p0 AS (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1){chain}
SELECT round(w0 + 1e-9, 6) AS w0, round(w1 + 1e-9, 6) AS w1 FROM p{steps}
"""


@query("learn_logistic", _descent_sql(8, 4.0))
def _(spark, d):
    """Whether an order line is large, from its scaled quantity and a constant."""
    rows = table(spark, d, "lineitem").select(
        (F.col("l_quantity") / 50).alias("x"), F.lit(1.0).alias("one"),
        (F.col("l_extendedprice") > 45_000).cast("double").alias("y"),
    )
    out = learn(rows, ["x", "one"], "y", "logistic", "constant", [0.0, 0.0], 8, 4.0)
    return out.select(rounded(F.col("params")[0], "w0"), rounded(F.col("params")[1], "w1"))


def _numbered(spark, d):
    return events(spark, d).select(F.col("event_id").alias("id"))


SAMPLERS = {
    "with_gaussian": lambda df: with_gaussian(df, mean=3.0, std=2.0),
    "with_poisson": lambda df: with_poisson(df, rate=4.0),
    "with_zipf": lambda df: with_zipf(df),
    "with_categorical": lambda df: with_categorical(df, [1.0, 2.0, 5.0]),
    "with_exponential": lambda df: with_exponential(df, rate=0.5),
}
for _name, _draw in SAMPLERS.items():
    query(_name)(lambda spark, d, draw=_draw: draw(_numbered(spark, d)))

_ZIPF = [(5.0 + k) ** -2 for k in range(100)]
_ZIPF_MEAN = sum(k * w for k, w in enumerate(_ZIPF)) / sum(_ZIPF)
_ZIPF_VAR = sum(k * k * w for k, w in enumerate(_ZIPF)) / sum(_ZIPF) - _ZIPF_MEAN**2
MOMENTS = {
    "with_gaussian": (3.0, 4.0), "with_poisson": (4.0, 4.0), "with_zipf": (_ZIPF_MEAN, _ZIPF_VAR),
    "with_categorical": (1.5, 0.5), "with_exponential": (2.0, 4.0),
}


@query("sampler_moments", "\nUNION ALL ".join(
    f"SELECT '{n}' AS sampler, count(*) AS n, true AS mean_fits, true AS variance_fits FROM events"
    for n in SAMPLERS))
def _(spark, d):
    """Mean and variance of every sampler, within six standard errors and a fifth."""
    out = None
    for name, draw in SAMPLERS.items():
        mean, var = MOMENTS[name]
        t = draw(_numbered(spark, d)).agg(
            F.count(F.lit(1)).alias("n"), F.avg("sample").alias("m"), F.var_samp("sample").alias("v")
        ).select(
            F.lit(name).alias("sampler"), "n",
            (F.abs(F.col("m") - mean) <= 6 * F.sqrt(var / F.col("n"))).alias("mean_fits"),
            (F.abs(F.col("v") - var) <= 0.2 * var).alias("variance_fits"),
        )
        out = t if out is None else out.unionByName(t)
    return out


@query("write_messages", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    where = scratch_path(spark, "messages")
    write_messages(events(spark, d).select("event_id", "event_type", "value"), where)
    return spark.read.schema("event_id bigint, event_type string, value double").json(where)


def _batch_sql(by: str, n: int) -> str:
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by} AS t_us, " if by else ""
    return f"""
WITH {SQL_EVENTS}, n AS (SELECT *, (row_number() OVER ({part}ORDER BY t, event_id) - 1) // {n} AS batch FROM e)
SELECT {lead}batch, count(*) AS size, string_agg('{{"event_id":' || event_id || '}}', ',' ORDER BY t, event_id)
       AS payloads FROM n GROUP BY {by + ', ' if by else ''}batch
"""


def _batches(out, *lead):
    return out.select(*lead, "batch", F.size("payloads").cast("bigint").alias("size"),
                      F.array_join("payloads", ",").alias("payloads"))


@query("batch_payloads", _batch_sql("", 100))
def _(spark, d):
    rows = events(spark, d).select("event_id", "ts")
    out = batch_payloads(rows, 100, "ts", "event_id")
    ids = F.transform("payloads", lambda p: F.to_json(F.from_json(p, "event_id bigint")))
    return _batches(out.withColumn("payloads", ids))


@query("batch_payloads_interval", _batch_sql(f"(t // {HOUR}) * {HOUR}", 5))
def _(spark, d):
    rows = events(spark, d).select("event_id", "ts")
    out = batch_payloads(rows, 5, "ts", "event_id", interval="1h")
    ids = F.transform("payloads", lambda p: F.to_json(F.from_json(p, "event_id bigint")))
    return _batches(out.withColumn("payloads", ids), us("start"))


@query("bulk_docs", """
SELECT '{"index":{"_index":"events","_id":"' || event_id || '"}}' AS action,
       '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS document FROM events
""")
def _(spark, d):
    return bulk_docs(events(spark, d).select("event_id", "user_id"), "events", "event_id")


