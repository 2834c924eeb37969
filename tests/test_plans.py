"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import sims
import weir

TABLES = "/root/testdata/sf0.001"
ROWS = sims.stream(31, 200, 200)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan after adaptive execution."""
    df.collect()
    return plan(df)


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("stream_")])
def test_no_nested_loops_or_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, TABLES))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    # No python worker gets rows one by one.
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize("make", [
    lambda df: weir.toggle(df, rows_per_chunk=20),
    lambda df: weir.rolling_count(df, "5s", rows_per_chunk=20),
    lambda df: weir.pack_by_count(df, 3, rows_per_chunk=20),
    lambda df: weir.queue_pops(df.where("id % 2 = 0"), df.where("id % 2 = 1"), rows_per_chunk=20),
    lambda df: weir.cache_lookup(df.drop("value"), df, "key", "value", "5s", rows_per_chunk=20),
    lambda df: weir.pack_by_value(df, "key", "5s", rows_per_chunk=20),
])
def test_only_chunk_totals_meet_in_one_window(spark, make):
    """A window without partition columns may only stand over the table of chunk totals, that is
    directly over an aggregate by chunk."""
    lines = plan(make(sims.frame(spark, ROWS))).split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = next(x for x in lines[i + 1:] if "Aggregate" in x or "Window" in x)
            assert "Aggregate(key" in below and "_chunk" in below, below


def test_lookups_split_a_hot_key(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        hot = spark.range(100_000).select(
            "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"),
            F.timestamp_seconds("id").alias("ts"))
        hot = hot.repartition(8)
        for df in (weir.is_member(hot, hot, "key"), weir.keep_members(hot, hot, "key"),
                   weir.drop_members(hot, hot.where("id < 10"), "key")):
            assert "skew=true" in final_plan(df)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_dedupe_limits_before_the_shuffle(spark):
    text = plan(weir.dedupe(sims.frame(spark, ROWS), "key"))
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_few_polls_sum_up_before_the_shuffle(spark):
    """Between scan and first shuffle stands a partial aggregate by slot."""
    df = spark.read.parquet(f"{TABLES}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    polls = weir.ticks_over(df, "6h")
    text = plan(weir.count_at(df, polls, "1h", "ts", "event_id"))
    assert "partial_min(_us" in text and "_slot" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text or (
        "ReadSchema: struct<ts:timestamp_ntz>" in text)


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(f"{TABLES}/events.parquet")
    kept = weir.mask(weir.filter_messages(df, "event_type = 'click'"), {"event_id": {}})
    text = plan(kept)
    assert "EqualTo(event_type,click)" in text
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in text


def test_lookups_in_the_cache_share_one_shuffle(spark):
    df = sims.frame(spark, ROWS)
    text = plan(weir.cache_lookup(df.drop("value"), df, "key", "value", "5s"))
    assert text.count("Exchange hashpartitioning") == 1


def test_rolling_shuffles_once(spark):
    """Apart from the count and the sample, the messages are shuffled once, and sorted once per chunk."""
    df = spark.read.parquet(f"{TABLES}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    text = plan(weir.rolling_average(df, "value", "1h", "ts", "event_id", rows_per_chunk=50))
    assert text.count("Exchange") == 1 and "FlatMapGroupsInArrow" in text


@pytest.mark.parametrize("make", [
    lambda a, b, c: weir.zip_join(a, b, clears=c, rows_per_chunk=20),
    lambda a, b, c: weir.queue_pops(a, b, rows_per_chunk=20),
    lambda a, b, c: weir.queue_peek(a, b, c.select("ts"), rows_per_chunk=20),
    lambda a, b, c: weir.pack_by_value(a, "key", "5s", rows_per_chunk=20),
    lambda a, b, c: weir.pack_by_count(a, 3, clears=b, flushes=c, rows_per_chunk=20),
    lambda a, b, c: weir.batch_payloads(a, 3, interval="5s", rows_per_chunk=20),
])
def test_chained_scans_compute_their_input_once(spark, make):
    """However many scans build on one another, each message is computed once, and shuffled by chunk once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    frames = [sims.frame(spark, sims.stream(s, 100, 100)) for s in (1, 2, 3)]
    out = make(*[f.mapInArrow(count, f.schema) for f in frames])
    text = plan(out)
    out.collect()
    assert 0 < seen.value <= 300 and seen.value % 100 == 0
    assert "hashpartitioning(_chunk" not in text and "hashpartitioning(_key" not in text
