"""Several message streams merged into one arrival order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import micros
from .ordering import Ordered, ordered

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Stream:
    """A DataFrame with its arrival time, its unique id (None for rows whose order among
    themselves does not matter, such as polls) and, for keyed operators, its key column."""

    df: DataFrame
    ts: str
    id: str | None = None
    key: str | None = None


def require_id(df: DataFrame, id: str | None) -> str:
    if id is None or id not in df.columns:
        raise ValueError("arrival order needs a unique tie-break column `id`")
    if not isinstance(df.schema[id].dataType, (*INTEGRAL, T.StringType)):
        raise ValueError(f"the tie-break column {id!r} must be an integer or a string")
    return id


def merged(*streams: Stream) -> tuple[DataFrame, list[str]]:
    """One DataFrame of all streams, and its order columns.

    Rows of stream ``i`` carry their columns in the struct ``_m{i}`` and have ``_rank`` = i. At
    equal time the earlier argument comes first. Keyed streams also have ``_key``.
    """
    parts, has_num, has_text = [], False, False
    for s in streams:
        if s.id is not None:
            require_id(s.df, s.id)
            text = isinstance(s.df.schema[s.id].dataType, T.StringType)
            has_text, has_num = has_text or text, has_num or not text
    for rank, s in enumerate(streams):
        text = s.id is not None and isinstance(s.df.schema[s.id].dataType, T.StringType)
        num_id = F.col(s.id) if s.id is not None and not text else F.lit(None)
        text_id = F.col(s.id) if text else F.lit(None)
        cols = [
            micros(s.ts).alias("_us"),
            F.lit(rank).alias("_rank"),
            *([num_id.cast("bigint").alias("_num_id")] if has_num else []),
            *([text_id.cast("string").alias("_text_id")] if has_text else []),
            *([F.col(s.key).alias("_key")] if s.key else []),
            F.struct("*").alias(f"_m{rank}"),
        ]
        part = s.df.select(*cols).where(F.col("_us").isNotNull())
        parts.append(part.where(F.col("_key").isNotNull()) if s.key else part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    order = ["_us", "_rank"]
    order += ["_num_id"] if has_num else []
    order += ["_text_id"] if has_text else []
    return out, order


def arrival(*streams: Stream, rows_per_chunk: int | None = None) -> Ordered:
    """The merged streams, cut into chunks along the arrival order."""
    df, order = merged(*streams)
    by = ["_key"] if streams[0].key else []
    return ordered(df, order, by, rows_per_chunk)


def of_stream(df: DataFrame, rank: int, *extra) -> DataFrame:
    """The rows of one stream with their own columns and the ``extra`` ones."""
    return df.where(F.col("_rank") == rank).select(f"_m{rank}.*", *extra)
