"""Model weights that follow a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import gradient, step_size

PARAMS = "batch bigint, rows bigint, params array<double>"


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """All weights written so far, one row per micro-batch."""
    return spark.read.schema(PARAMS).parquet(path)


def _before(spark: SparkSession, path: str, batch: int, init: list[float]) -> list[float]:
    """The weights that the batch before this one wrote; every batch writes its own, an empty one, too."""
    return list(read_params(spark, f"{path}/run={batch - 1}").first()["params"]) if batch else list(init)


def learn_stream(
    df: DataFrame, features: list[str], response: str, path: str, checkpoint: str,
    loss: str = "logistic", step: str = "constant", init: list[float] | None = None,
    eta: float = 1.0, trigger: dict | None = None,
) -> StreamingQuery:
    """One gradient step per micro-batch (T9); the weights of every batch are written below ``path``.

    A batch starts from the weights of the batch before it and overwrites its own, so a batch that
    is run again after a failure gives the same weights.
    """
    start = list(init) if init is not None else [0.0] * len(features)

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        params = _before(spark, path, batch_id, start)
        n, g = gradient(batch, features, response, params, loss)
        size = step_size(step, batch_id + 1, eta)
        new = [float(p - size * d) for p, d in zip(params, g)] if n else params
        row = spark.createDataFrame([(batch_id, n, new)], PARAMS)
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/run={batch_id}")

    return (
        df.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
