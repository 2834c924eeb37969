"""No task gets much more rows than others, however few partitions the session's shuffles have."""

import pytest
from pyspark.sql import functions as F

import weir
from weir.plans.ordering import ordered


@pytest.fixture
def two_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def most_rows(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_scans_have_bounded_tasks(spark, two_partitions, by):
    df = spark.range(1_200_000).withColumn("k", F.col("id") % 1000)
    scanned = ordered(df, ["id"], by).scan(n=("sum", F.lit(1))).df
    assert most_rows(scanned) <= 500_000
    assert scanned.agg(F.max("n")).first()[0] == (1_200 if by else 1_200_000)


def test_zip_join_groups_in_bounded_tasks(spark, two_partitions):
    df = spark.range(700_000).withColumn("ts", F.timestamp_micros("id"))
    pairs = weir.zip_join(df, df.withColumn("ts", F.timestamp_micros(F.col("id") + 10)))
    assert pairs.where("A.id = B.id").count() == 700_000
    assert most_rows(pairs) <= 250_000


def test_histogram_reads_have_bounded_tasks(spark, two_partitions):
    """Labels are dealt before each is given all polls, and no task sums up what it gave them."""
    df = spark.range(3_000).withColumn("ts", F.timestamp_micros("id"))
    polls = spark.range(100).select(F.timestamp_micros(F.lit(10_000) + F.col("id")).alias("ts"))
    out = weir.histogram_at(df, polls, "id", "1s", long=True)
    assert out.where("Count = 1").count() == out.count() == 300_000
    assert most_rows(out) <= 100_000
    assert "keys=[Label#" in (text := out._jdf.queryExecution().toString()) and "_lo#" not in "".join(
        line for line in text.splitlines() if "HashAggregate" in line)
