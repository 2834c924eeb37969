"""Parquet tables as message streams, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def use_utc(spark: SparkSession) -> None:
    """Timestamps without a zone are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def zoned(df: DataFrame) -> DataFrame:
    """Turn zone-less timestamp columns into timestamps (UTC session)."""
    naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return zoned(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``).

    Where that is unset, the folder of Spark's warehouse is used: it is shared as well, as tables lie there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/weir-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written below the shared folder and read again: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
