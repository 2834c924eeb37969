"""Writing messages out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.duration import interval_micros
from ..functions.expressions import MICROS
from ..operators.project import to_messages
from ..plans.streams import Stream, arrival, require_id


def write_messages(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line below ``path``, one file per partition (K1)."""
    to_messages(df).write.mode(mode).text(path)


def batch_payloads(
    df: DataFrame, max_batch: int, ts: str = "ts", id: str = "id", interval: str | None = None,
    dest: Column | None = None, rows_per_chunk: int | None = None,
) -> DataFrame:
    """Batches of at most ``max_batch`` JSON payloads in arrival order (K2): ``batch``, ``payloads``.

    ``interval`` also closes a batch at every multiple of the interval; the column ``start`` is the
    interval's begin then. ``dest`` adds a constant ``dest``, such as a topic.
    """
    from ..operators.packs import interval_start

    if max_batch < 1:
        raise ValueError("a batch holds at least one message")
    require_id(df, id)
    if interval is not None:
        interval_micros(interval)
        df = df.where(F.col(ts).isNotNull())
    scan = arrival(Stream(df, ts, id), rows_per_chunk=rows_per_chunk).scan(_n=("sum", F.lit(1)))
    by = []
    position = F.col("_n") - 1
    if interval is not None:
        start = interval_start("_m0." + ts, interval)
        before = scan.scan(exclusive=True, _prev=("max", F.unix_micros(start)))
        first = F.col("_prev").isNull() | (F.col("_prev") < F.unix_micros(start))
        scan = before.scan(_base=("max", F.when(first, F.col("_n"))))
        position = F.col("_n") - F.col("_base")
        by = [start.alias("start")]
    batch = F.floor(position / max_batch).alias("batch")
    rows = scan.df.select(*by, batch, "_n", F.to_json("_m0", MICROS).alias("_payload"))
    keys = (["start"] if by else []) + ["batch"]
    out = rows.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_n", "_payload"))), lambda r: r["_payload"]
        ).alias("payloads")
    )
    return out if dest is None else out.withColumn("dest", dest)


def publish(df: DataFrame, send: Callable[[list[bytes]], None], max_batch: int = 1) -> None:
    """Hand the JSON payloads to ``send`` in batches of at most ``max_batch`` (K2, K3).

    Runs where the partitions are. A retried task sends its batches again, so the receiver sees
    every message at least once.
    """
    if max_batch < 1:
        raise ValueError("a batch holds at least one message")

    def run(rows) -> None:
        batch = []
        for row in rows:
            batch.append(row["message"].encode())
            if len(batch) == max_batch:
                send(batch)
                batch = []
        if batch:
            send(batch)

    to_messages(df).foreachPartition(run)


def bulk_docs(df: DataFrame, index: str, id: str | None = None) -> DataFrame:
    """``action`` and ``document`` JSON lines for a document index (K3)."""
    target = {"_index": F.lit(index)}
    if id is not None:
        target["_id"] = F.col(id).cast("string")
    action = F.struct(F.struct(*[c.alias(k) for k, c in target.items()]).alias("index"))
    return df.select(F.to_json(action).alias("action"), F.to_json(F.struct("*"), MICROS).alias("document"))


def show_messages(df: DataFrame, n: int = 20) -> None:
    """Print the first ``n`` messages (K4)."""
    to_messages(df).show(n, truncate=False)


__all__ = [
    "batch_payloads", "bulk_docs", "publish", "show_messages", "write_messages",
]
