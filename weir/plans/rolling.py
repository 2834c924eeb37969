"""Counts and sums over the trailing window of every row, with one shuffle of the rows.

Time is cut into chunks at quantiles of a bounded sample, and a row goes to its own chunk and, as a bare time and value, to each
chunk that begins within a window's length behind it (its halo). So every chunk holds all that its rows look
back on, and is worked on alone: one sort, two binary searches for the ends of the windows, and sums that are never
subtracted, i.e. a running sum from the start of a block of the window's width, and one from its end backwards.

An instant with more rows than a chunk can't be cut by time. Its rows are added up to one row that stands for all of them in
the chunks, and they take their own result from the trailing sums at these few instants.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.expressions import array_literal, micros, with_count_le
from .ordering import CHUNK, MIN_ROWS_PER_CHUNK, SAMPLES_PER_CHUNK, _once, _sample
from .trailing import trailing_sums

#: More copies of a row than this on average, and the caller's other plan is the better one.
MOST_COPIES = 1.0
MOST_CHUNKS = 20_000
#: A task holds a chunk and its halo in Python, so chunks are cut smaller than those of Spark's own windows.
FRAME_ROWS = 250_000
#: Larger chunks, for windows that would copy too many rows otherwise.
ROWS_PER_CHUNK = 1_000_000


def running(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running sums that start anew with every group of neighbours, by doubling steps (nothing is subtracted)."""
    out = values.copy()
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(1, np.int64)
    longest = int(np.diff(np.append(starts, len(group))).max(initial=0))
    step = 1
    while step < longest:
        out[step:] = out[step:] + np.where(group[step:] == group[:-step], out[:-step], 0.0)
        step *= 2
    return out


def window_sums(us: np.ndarray, n: np.ndarray, total: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For ascending times: sums of n and of total over the rows from ``width`` before a row up to its own time."""
    low, high = np.searchsorted(us, us - width, "left"), np.searchsorted(us, us, "right")
    seen = np.append(0, np.cumsum(n))
    block = us // (width + 1)
    ahead = running(total, block)
    back = running(total[::-1], block[::-1])[::-1]
    # a window reaches into the block before, of which it holds the end, or begins where its own block does
    sums = ahead[high - 1] + np.where(block[low] < block[high - 1], back[low], 0.0)
    return seen[high] - seen[low], sums


def _cuts(rows: DataFrame, n: int, chunks: int) -> tuple[list[int], list[int], list[int]]:
    """Ascending cut times, the instants that hold more than one cut, and the sampled times."""
    sample = sorted(r[0] for r in _sample(rows.select("_us"), n, chunks * SAMPLES_PER_CHUNK).collect())
    picks = [sample[len(sample) * i // chunks] for i in range(1, chunks)] if sample else []
    hot = sorted({a for a, b in zip(picks, picks[1:]) if a == b})
    return sorted(set(picks)), hot, sample


def rolling_sums(
    df: DataFrame, ts: str, id: str, width: int, value: Column | None, rows_per_chunk: int | None = None,
) -> DataFrame | None:
    """``df`` with ``_n``, the rows (with a value, where one is given) of the window that ends with the row, and ``_total``, the
    sum of their values. Rows of equal time see each other. Rows without a time have 0 and null.

    None where the window is so long for the number of rows in a chunk that rows would be copied too often.
    """
    weight = F.lit(1) if value is None else value.isNotNull().cast("int")
    rows = _once(df.withColumns({
        "_us": micros(ts), "_w": weight.cast("bigint"), "_v": F.coalesce(F.lit(0.0) if value is None else value, F.lit(0.0)),
    }))
    timed = rows.where("_us IS NOT NULL")
    n, cores = timed.count(), df.sparkSession.sparkContext.defaultParallelism
    for limit in [rows_per_chunk] if rows_per_chunk else [FRAME_ROWS, ROWS_PER_CHUNK]:
        chunks = min(MOST_CHUNKS, max(math.ceil(n / limit), min(cores, n // min(limit, MIN_ROWS_PER_CHUNK)), 1))
        cuts, hot, sample = _cuts(timed, n, chunks)
        places = np.array(cuts, np.int64)
        times = np.array(sample, np.int64)
        copies = np.searchsorted(places, times + width, "right") - np.searchsorted(places, times, "right")
        if not len(copies) or copies.mean() <= MOST_COPIES:
            break
    else:
        return None
    bounds = array_literal(cuts, "array<bigint>")
    is_hot = F.array_contains(array_literal(hot, "array<bigint>"), F.col("_us")) if hot else F.lit(False)
    single = rows.where(F.coalesce(~is_hot, F.lit(True)))
    if hot:
        sums = rows.where(is_hot).groupBy("_us").agg(F.sum("_w").alias("_w"), F.sum("_v").alias("_v"))
        # their own columns are null, so they come out as no row of the input
        single = single.withColumn("_own", F.lit(True)).unionByName(
            sums.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    else:
        single = single.withColumn("_own", F.lit(True))
    placed = with_count_le(single, CHUNK, bounds, len(cuts), F.col("_us"))
    placed = with_count_le(placed, "_end", bounds, len(cuts), F.col("_us") + width)
    # rows without a time are dealt by their id
    spread = F.pmod(F.xxhash64(id), F.lit(len(cuts) + 1)).cast("int")
    first = F.when(F.col("_us").isNull(), spread).otherwise(F.col(CHUNK))
    chunk = F.explode(F.sequence(first, F.greatest(first, F.when(F.col("_us").isNotNull(), F.col("_end")))))
    dealt = placed.withColumn("_first", first).withColumn(CHUNK, chunk)
    mine = F.col("_own") & (F.col(CHUNK) == F.col("_first"))
    dealt = dealt.select(
        CHUNK, "_us", "_w", "_v", mine.alias("_own"), *[F.when(mine, F.col(c)).alias(c) for c in df.columns]
    )
    schema = T.StructType([
        *[T.StructField(f.name, f.dataType, True) for f in df.schema],
        T.StructField("_n", T.LongType()), T.StructField("_total", T.DoubleType()),
    ])
    names, target = df.columns, to_arrow_schema(schema)

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("_us", "ascending")]))  # those without a time come last
        us = rows["_us"].drop_null().to_numpy()
        w, v = rows["_w"].to_numpy()[:len(us)], rows["_v"].to_numpy()[:len(us)]
        n, total = window_sums(us, w, v, width)
        rest = rows.num_rows - len(us)
        out = rows.select(names).append_column("_n", pa.array(np.append(n, np.zeros(rest, np.int64)), pa.int64()))
        out = out.append_column("_total", pa.chunked_array([pa.array(total, pa.float64()), pa.nulls(rest, pa.float64())]))
        return out.filter(rows["_own"]).cast(target)  # times come in the session's zone and go out in UTC

    out = dealt.groupBy(CHUNK).applyInArrow(work, schema)
    if not hot:
        return out
    at = df.sparkSession.createDataFrame([(t,) for t in hot], "_us bigint")
    live = trailing_sums(
        timed.select("_us", F.col(id).alias("_id"), "_w", "_v"), at, width, {"_n": F.col("_w"), "_total": F.col("_v")}, poll_times=hot,
    ).select(F.col("_us").alias("_at"), F.col("_n").cast("bigint").alias("_n"), "_total")
    # at most one row for each cut
    own = rows.where(is_hot).join(F.broadcast(live), F.col("_us") == F.col("_at")).select(*names, "_n", "_total")
    return out.unionByName(own)
