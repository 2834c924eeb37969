"""Drive a streaming query over the data that is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.tables import scratch_path


def run_available(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` until all available input is used, and return what it appended.

    Output and checkpoint go to new folders below the shared one.
    """
    spark = df.sparkSession
    out, check = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-check")
    run = (
        df.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", check).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
