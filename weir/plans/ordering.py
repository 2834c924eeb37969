"""Order-dependent work without a single big partition.

Several operators depend on the arrival order of *all* rows: a global index, a running sum, the
last value seen. A window without ``partitionBy`` would pull every row into one task. Here the
rows are cut into chunks along their total order first:

1. cut points: a bounded sample of the order keys is taken, and its quantiles are the cuts. The
   order keys include the unique id, so even rows that all share one timestamp are cut evenly;
2. the rows are shuffled by chunk once and written as a table bucketed by chunk, from which all
   further steps read without a shuffle, however many scans follow one another;
3. a window inside each chunk gives the local running value;
4. one aggregate row per chunk gives the chunk totals, and a window over that small table gives
   what each chunk starts from. It is written out as well, so a scan that builds on another does
   not run it again;
5. the start values are joined back by chunk, which moves only the small side.

An input that is costly to compute (with a shuffle, a window or Python in its plan) is written out
first, as the count, the sample and the shuffle would each compute it. Jobs therefore run while the
result is being built. Where there is one chunk only, nothing is written.

With ``by`` columns the scan restarts for every key. Keys are windows of their own then, and only
the keys that hold more rows than one chunk are cut along the order as well.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import array_literal, count_le, with_count_le
from .tables import scratch_path, stored

ROWS_PER_CHUNK = 100_000
#: A task holds several chunks, as they are dealt by hash: of so many rows on average, none has much more than twice as many.
ROWS_PER_TASK = 250_000
#: Keys of more rows than this are cut.
ROWS_PER_KEY = 250_000
MIN_ROWS_PER_CHUNK = 20_000
MAX_CHUNKS = 20_000
SAMPLES_PER_CHUNK = 20
HOT_SAMPLE_ROWS = 1_000_000
MAX_HOT_KEYS = 20_000

CHUNK = "_chunk"
#: Parts of a plan that make reading it several times costly.
COSTLY = ("Exchange", "Window", "Generate", "Join", "InPandas", "InArrow", "EvalPython", "Aggregate")


def _storable(kind: T.DataType) -> bool:
    """Whether a Parquet file can hold the type."""
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, T.MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return not isinstance(kind, (T.NullType, T.CalendarIntervalType))


def _once(df: DataFrame) -> DataFrame:
    """The rows, written out if it would be costly to read them several times."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return stored(df, "rows") if _storable(df.schema) and any(word in plan for word in COSTLY) else df


def _bucketed(df: DataFrame, keys: list[str], order: list[str], tasks: int) -> DataFrame:
    """The rows shuffled by ``keys`` once and written as a table with a bucket for each of ``tasks``.

    The table is taken out of the catalog at once: its files and this DataFrame are all that is used.
    """
    spark, name = df.sparkSession, f"chunks_{uuid.uuid4().hex}"
    writer = df.repartition(tasks, *keys).write.format("parquet").bucketBy(tasks, *keys).sortBy(*keys, *order)
    writer.option("path", scratch_path(spark, "chunks")).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def _sample(df: DataFrame, n: int, wanted: int) -> DataFrame:
    return df if n <= wanted else df.sample(min(1.0, wanted / n), seed=11)


def _null_first(row) -> tuple:
    return tuple((v is not None, v) for v in row)


def _cuts(df: DataFrame, order: list[str], n: int, chunks: int) -> list[tuple]:
    """At most ``chunks - 1`` ascending order keys. Only the bounded sample is collected."""
    sample = _sample(df.select(*order), n, chunks * SAMPLES_PER_CHUNK).collect()
    rows = sorted((tuple(r) for r in sample), key=_null_first)
    picks = []
    for i in range(1, chunks):
        row = rows[len(rows) * i // chunks] if rows else None
        if row is not None and (not picks or _null_first(row) > _null_first(picks[-1])):
            picks.append(row)
    return picks


def _with_cut_index(df: DataFrame, order: list[str], cuts: list[tuple]) -> DataFrame:
    """The number of cuts at or before each row as the column CHUNK.

    The first order column decides, but for times that hold more than one cut: only rows of such
    hot instants are placed by the whole order key.
    """
    first = [cut[0] for cut in cuts]
    kind = df.schema[order[0]].dataType.simpleString()
    df = with_count_le(
        df, CHUNK, array_literal(first, f"array<{kind}>"), len(cuts), F.col(order[0])
    )
    hot = sorted({a for a, b in zip(first, first[1:]) if a is not None and a == b})
    if not hot:
        return df
    types = [df.schema[c].dataType for c in order]
    ddl = ",".join(f"k{i}:{t.simpleString()}" for i, t in enumerate(types))
    values = [{f"k{i}": v for i, v in enumerate(cut)} for cut in cuts]
    bounds = array_literal(values, f"array<struct<{ddl}>>")
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    exact = count_le(bounds, len(cuts), key.cast(f"struct<{ddl}>"))
    return df.withColumn(CHUNK, F.when(F.col(order[0]).isin(hot), exact).otherwise(F.col(CHUNK)))


def spread(df: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """The rows shuffled by ``keys`` into so many tasks, where the session has fewer cores or shuffle partitions.

    Up to as many tasks as cores are left to Spark, which else puts partitions together by their compressed size,
    however many rows that is.
    """
    spark = df.sparkSession
    enough = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df if tasks <= enough else df.repartition(tasks, *keys)


class Ordered:
    """Rows cut into chunks along ``order``, ready for running aggregates.

    ``order`` are column names that form a total order (the last one a unique id); a few rows that
    carry no weight in the scan, such as polls, may tie. ``by`` are non-null key columns.
    """

    def __init__(
        self, df: DataFrame, order: list[str], by: list[str], chunked: bool, carry: bool,
        tasks: int = 0,
    ):
        self.df, self.order, self.by = df, order, by
        self.chunked, self.carry, self.tasks = chunked, carry, tasks
        self.width = tasks
        if carry and _storable(df.schema):
            self.df, self.tasks = _bucketed(df, self.keys, order, max(tasks, 1)), 0

    @property
    def keys(self) -> list[str]:
        return [*self.by, CHUNK] if self.chunked else list(self.by)

    def replace(self, df: DataFrame) -> Ordered:
        """The same chunks over a narrower or widened row."""
        out = Ordered(df, self.order, self.by, self.chunked, carry=False)
        out.carry, out.width = self.carry, self.width
        return out

    def spread(self, keys: list[str]) -> DataFrame:
        """The rows shuffled by ``keys`` into tasks of ROWS_PER_TASK, where the session's shuffles may give
        larger ones. The windows keep this partitioning."""
        return spread(self.df, keys, self.tasks)

    def scan(self, exclusive: bool = False, **running: tuple[str, Column]) -> Ordered:
        """Add running aggregates: ``name=(kind, column)``, kind one of sum, min, max, last.

        The running value covers all rows up to the current one, or up to the one before it
        with ``exclusive``. Null inputs are ignored; a sum over nothing is 0.
        """
        keys = self.keys
        frame = (
            Window.partitionBy(*keys)
            .orderBy(*self.order)
            .rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
        )
        local = self.spread(keys).withColumns(
            {name: _windowed(kind, col).over(frame) for name, (kind, col) in running.items()}
        )
        if not self.carry:
            return self.replace(_fill_sums(local, running))
        totals = self.df
        if self.by:
            totals = totals.where(F.col(CHUNK) > 0)
        position = F.struct(*self.order)
        totals = totals.groupBy(*keys).agg(
            *[_total(kind, col, position).alias(name) for name, (kind, col) in running.items()]
        )
        before = (
            Window.partitionBy(*self.by)
            .orderBy(CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        start = totals.select(
            *keys,
            *[
                _windowed(kind, F.col(name)).over(before).alias(f"_start_{name}")
                for name, (kind, _) in running.items()
            ],
        )
        start = stored(start, "starts") if _storable(start.schema) else start
        joined = local.join(start, keys, "left")
        merged = joined.withColumns(
            {
                name: _merge(kind, F.col(f"_start_{name}"), F.col(name))
                for name, (kind, _) in running.items()
            }
        ).drop(*[f"_start_{name}" for name in running])
        return self.replace(_fill_sums(merged, running))


def _windowed(kind: str, col: Column) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](col)


def _total(kind: str, col: Column, position: Column) -> Column:
    if kind == "last":
        return F.max_by(col, F.when(col.isNotNull(), position))
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](col)


def _merge(kind: str, start: Column, local: Column) -> Column:
    if kind == "last":
        return F.coalesce(local, start)
    if kind == "sum":
        return F.when(start.isNull(), local).when(local.isNull(), start).otherwise(start + local)
    return (F.least if kind == "min" else F.greatest)(start, local)


def _fill_sums(df: DataFrame, running: dict) -> DataFrame:
    sums = [name for name, (kind, _) in running.items() if kind == "sum"]
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in sums}) if sums else df


def ordered(
    df: DataFrame,
    order: list[str],
    by: list[str] | None = None,
    rows_per_chunk: int | None = None,
    bounded: bool = False,
    tasks: int = 0,
) -> Ordered:
    """Cut ``df`` into chunks along ``order``; see the module text.

    ``bounded`` states that every group of ``by`` is known to be small, which saves the look at
    the data; ``tasks`` then says how many tasks the rows are worth. Otherwise two small jobs run here: a count, and a sample of the keys.
    """
    by = list(by or [])
    if bounded:
        return Ordered(df, order, by, chunked=False, carry=False, tasks=tasks)
    df = _once(df)
    n = df.count()
    if by:
        return _ordered_by(df, order, by, n, rows_per_chunk or ROWS_PER_KEY)
    limit = rows_per_chunk or ROWS_PER_CHUNK
    cores = df.sparkSession.sparkContext.defaultParallelism
    smallest = min(limit, MIN_ROWS_PER_CHUNK)
    chunks = min(MAX_CHUNKS, max(math.ceil(n / limit), min(cores, n // smallest), 1))
    cuts = _cuts(df, order, n, chunks) if chunks > 1 else []
    cut = _with_cut_index(df, order, cuts)
    return Ordered(cut, order, by, chunked=True, carry=bool(cuts), tasks=_tasks(df, n, len(cuts) + 1))


def _tasks(df: DataFrame, n: int, pieces: int) -> int:
    """Into how many tasks to shuffle n rows in so many chunks: several small chunks share one."""
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(math.ceil(n / ROWS_PER_TASK), min(pieces, shuffled))


def _ordered_by(df, order, by, n, limit) -> Ordered:
    if n <= limit:
        return Ordered(df, order, by, chunked=False, carry=False)
    limit = max(limit, n // MAX_CHUNKS)
    share = min(1.0, HOT_SAMPLE_ROWS / n)
    hot = (
        _sample(df.select(*by), n, HOT_SAMPLE_ROWS)
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > limit * share)
        .orderBy(F.desc("_rows"))
        .select(*by)
        .limit(MAX_HOT_KEYS)
        .collect()
    )
    pieces = math.ceil(n / limit)
    tasks = _tasks(df, n, pieces)
    if not hot:
        return Ordered(df, order, by, chunked=False, carry=False, tasks=tasks)
    schema = T.StructType([df.schema[c] for c in by])
    hot_keys = df.sparkSession.createDataFrame(hot, schema).withColumn("_hot", F.lit(True))
    cuts = _cuts(df, order, n, pieces)
    # The broadcast side has at most MAX_HOT_KEYS rows.
    marked = _with_cut_index(df.join(F.broadcast(hot_keys), by, "left"), order, cuts)
    index = F.when(F.col("_hot"), F.col(CHUNK) + 1).otherwise(0)
    marked = marked.withColumn(CHUNK, index).drop("_hot")
    return Ordered(marked, order, by, chunked=True, carry=True, tasks=tasks)


def with_index(
    df: DataFrame, order: list[str], name: str = "idx", rows_per_chunk: int | None = None
) -> DataFrame:
    """Number the rows 0, 1, 2, … along ``order``."""
    scanned = ordered(df, order, rows_per_chunk=rows_per_chunk).scan(**{name: ("sum", F.lit(1))})
    return scanned.df.withColumn(name, F.col(name) - 1).drop(CHUNK)
