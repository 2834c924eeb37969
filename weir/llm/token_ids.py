"""Token ids as binary blocks: frequency ranks, byte-aligned variable length, control bytes apart.

An id's rank by frequency takes one to four bytes; two bits for each id, four ids to a control byte, tell how many.
Control bytes and data bytes of a block are separate columns of a Parquet file, so numpy decodes a block by looking up
the control bytes in a table of lengths. A block holds whole documents. Blocks lie in ascending doc_id order: the rows
are range-partitioned and sorted, each partition is a ``chunk``, and ``before`` counts a chunk's ids before the block.

Texts: null counts as empty; every document gets the end id, so none has no ids. Rows of one doc_id (or without
one, which come first) are ordered by the hash of their ids; equal rows each count. An empty table gives no
blocks. Other columns are ignored; doc_id is of any type that can be sorted. Encoding is that of the tokenizers library: runs of
common letters are cut and merged by ``ended``, which tests hold against the library, and all others go through the library.
A document is held whole, with a block of others, in one task; nothing else is.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import scratch_path
from .bpe import loaded, portions
from .common import pick, small_side, stored
from .ended import EndedBpe

#: Bytes of each of the four ids of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1
PLACES = np.arange(4)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    more = (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    # columns that no value uses are left out
    used = int(more.max(initial=0)) + 1
    data = v.view(np.uint8).reshape(-1, 4)[:, :used][PLACES[:used] <= more[:, None]]
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = more
    return (codes.reshape(-1, 4) << (2 * PLACES)).sum(axis=1).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of a block."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    used = int(lengths.max(initial=1))
    out = np.zeros((n, 4), np.uint8)
    out[:, :used][PLACES[:used] < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def width(path: str, end_id: int | None) -> str:
    """The little-endian type that holds every id of the vocabulary: two bytes if they suffice."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    top = max([*data["model"]["vocab"].values(), *(x["id"] for x in data.get("added_tokens", [])), end_id or 0])
    return "<u2" if top < 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """doc_id, n_tokens, ids (values of the vocabulary's ``width``), the end id included."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    end, kind = np.array([] if end_id is None else [end_id], np.int32), width(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(spec.value, EndedBpe)
        for b in portions(batches):
            ids = [np.append(x, end).astype(kind) for x in encoder.encode(b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([
                b["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()),
            ], names=["doc_id", "n_tokens", "ids"])

    texts = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def ranked(ids: DataFrame, kind: str) -> np.ndarray:
    """Token ids by falling frequency, then by id. Counts are summed per task first; the result is one number per
    id of the vocabulary, which bounds what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            n = np.bincount(np.frombuffer(b"".join(b["ids"].to_pylist()), kind))
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])

    rows = ids.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return np.array([t for t, _ in sorted(((r[0], r[1]) for r in rows), key=lambda x: (-x[1], x[0]))], np.int64)


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int | None = 2, block_ids: int = 1 << 16) -> None:
    """Encode all texts and write ``folder``/ranks and ``folder``/blocks."""
    spark = docs.sparkSession
    ids = stored(encoded(docs, path, end_id), "token-ids")
    kind = width(path, end_id)
    size_of = np.dtype(kind).itemsize
    by_rank = ranked(ids, kind)
    spark.createDataFrame([(by_rank.tolist(),)], "ids array<long>").write.parquet(f"{folder}/ranks")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(rank)

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "block", "before", "n_ids", "doc_ids", "lengths", "control", "data"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, block, before, size, held = TaskContext.get().partitionId(), 0, 0, 0, []

        def row() -> pa.RecordBatch:
            nonlocal block, before, size, held
            flat = np.frombuffer(b"".join(x for _, xs in held for x in xs), kind)
            control, data = pack(shared.value[flat])
            docs_of = pa.concat_arrays([d for d, _ in held])
            one = lambda x, t: pa.array([x], t)
            listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            lengths = pa.array([len(x) // size_of for _, xs in held for x in xs], pa.int32())
            out = [one(chunk, pa.int32()), one(block, pa.int32()), one(before, pa.int64()), one(len(flat), pa.int64()),
                   listed(docs_of), listed(lengths), one(control, pa.binary()), one(data, pa.binary())]
            block, before, size, held = block + 1, before + len(flat), 0, []
            return pa.RecordBatch.from_arrays(out, names=names)

        for b in batches:
            first, part = 0, []
            for at, x in enumerate(b["ids"].to_pylist()):
                part.append(x)
                size += len(x) // size_of
                if size >= block_ids:
                    held.append((b["doc_id"].slice(first, len(part)), part))
                    yield row()
                    first, part = at + 1, []
            if part:
                held.append((b["doc_id"].slice(first, len(part)), part))
        if held:
            yield row()

    tie = ids.withColumn("tie", F.xxhash64("ids"))
    ordered = tie.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    ordered.mapInArrow(blocks, (
        f"chunk int, block int, before long, n_ids long, doc_ids array<{id_kind}>, lengths array<int>, control binary, data binary"
    )).write.parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (binary) from the files alone.

    All ids are read and summed up; without ``with_ids`` they don't leave the task that reads them.
    """
    table = spark.read.schema("ids array<long>").parquet(f"{folder}/ranks").collect()
    by_rank = spark.sparkContext.broadcast(np.array(table[0][0], "<u4"))
    blocks = spark.read.parquet(f"{folder}/blocks")
    # one row for each chunk, that is for each partition of the writer
    chunks = blocks.groupBy("chunk").agg(F.max(F.col("before") + F.col("n_ids")).alias("n"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select("chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(len(b)):
                cell = lambda name: b[name][at].as_py()  # noqa: B023, E731
                ids = by_rank.value[unpack(cell("control"), cell("data"), cell("n_ids"))]
                lengths = b["lengths"][at].values.to_numpy().astype(np.int64)
                ends = np.cumsum(lengths)
                raw = ids.view(np.uint8)
                parts = [raw[4 * i:4 * j] for i, j in zip((ends - lengths).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    b["doc_ids"][at].values, pa.array(cell("first") + cell("before") + ends - lengths), pa.array(lengths),
                    pa.array([zlib.crc32(x) for x in parts], pa.int64()), *([pa.array([x.tobytes() for x in parts], pa.binary())] if with_ids else []),
                ], names=names)

    id_kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.join(small_side(starts, 16), "chunk").mapInArrow(
        run, f"doc_id {id_kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    )


def token_files(docs: DataFrame, path: str, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Write the ids of all documents below the shared folder and read the files back; see ``read_ids``."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write_ids(docs, path, folder, end_id)
    return read_ids(docs.sparkSession, folder, with_ids)
