"""Packing by power-of-two decomposition: no sequence crosses documents, and none is padded.

A document of n tokens is cut into pieces of binary lengths: as many of the greatest length (a power of two) as fit, then
one for each bit set in the rest, long ones first. Each piece is a sequence of its own, and sequences of one length
form a bucket, so a batch from one bucket is a full rectangle. The pieces are written to one folder for each length.
Sequences are numbered bucket by bucket, the longest first, and within a bucket in the order of the files: each writing
task is a ``chunk`` that counts its pieces, and the sums of a table of one row for each chunk and bucket give where it
starts. So neither texts nor ids are shuffled.

Ids are those of the tokenizers library. Where the vocabulary's merges are ranked by their ids, texts of common letters go
through tiktoken with the same vocabulary, which is several times faster; texts with other letters (on which the Unicode
versions of the two differ) or special tokens, and all texts of other vocabularies, go through the library itself. Python
is used as neither has a SQL form.

Texts: null counts as empty; with an end id every document has a token, and without one a document without tokens has no
piece. Long texts are cut like others and held one at a time. Repeated rows, and rows without doc_id or of one doc_id, are
packed each on its own; doc_id may be of any type. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import scratch_path
from .bpe import BYTE_PLAIN, BYTE_WORDS, byte_letters
from .common import pick, small_side

IDS = pa.list_(pa.int32())


class ByteEncoder:
    """Ids of texts by a vocabulary file of the tokenizers library, which is loaded where it is needed."""

    def __init__(self, spec: str):
        self.spec, self.library = spec, None
        data = json.loads(spec)
        self.special = [x["content"] for x in data.get("added_tokens", [])]
        self.plain = regex.compile(BYTE_PLAIN)
        self.ranks = self.fast = None
        model, vocab = data["model"], data["model"].get("vocab", {})
        made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model.get("merges", [])]
        byte_level = (data.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not data.get("normalizer")
        settings = ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges")
        if byte_level and not any(model.get(k) for k in settings) and made == sorted(made) and len(vocab) == len(made) + 256 + sum(
            x in vocab for x in self.special
        ):
            import tiktoken

            letters = byte_letters()
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=BYTE_WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and self.plain.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids


def binary_lengths(totals: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """How many pieces each document has, and the lengths of all pieces, long ones first within a document."""
    whole, rest = totals // longest, totals % longest
    bits = longest >> np.arange(1, longest.bit_length(), dtype=np.int64)
    has = (rest[:, None] & bits) > 0
    counts = whole + has.sum(axis=1)
    row, bit = np.nonzero(has)
    owner = np.concatenate([np.repeat(np.arange(len(totals)), whole), row])
    lengths = np.concatenate([np.full(int(whole.sum()), longest, np.int64), bits[bit]])
    return counts, lengths[np.argsort(owner, kind="stable")]


def write_pieces(docs: DataFrame, path: str, folder: str, longest: int = 2048, end_id: int | None = 1, batch: int = 1 << 20) -> None:
    """Encode all texts and write ``folder``/length=…: doc_id, start, doc_tokens, chunk, place (in its bucket of the chunk), ids.

    Pieces are handed over whenever they hold ``batch`` ids, so a task holds no more than those and one text.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the greatest length must be a power of two")
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    names = ["doc_id", "start", "doc_tokens", "chunk", "place", "ids", "length"]
    end = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, chunk = ByteEncoder(spec.value), TaskContext.get().partitionId()
        placed = np.zeros(longest.bit_length(), np.int64)

        def pieces(doc_ids: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
            totals = np.array([len(x) for x in held], np.int64)
            counts, lengths = binary_lengths(totals, longest)
            owner = np.repeat(np.arange(len(held)), counts)
            ends = np.cumsum(lengths)
            bucket = np.log2(lengths).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            n = np.bincount(bucket, minlength=len(placed))
            place = np.empty(len(lengths), np.int64)
            place[order] = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(placed, n)
            placed[:] += n
            before = np.cumsum(totals) - totals
            ids = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(np.concatenate(held)))
            return pa.RecordBatch.from_arrays([
                doc_ids.take(pa.array(owner)), pa.array(ends - lengths - before[owner]), pa.array(totals[owner]),
                pa.array(np.full(len(owner), chunk, np.int32)), pa.array(place), ids, pa.array(lengths.astype(np.int32)),
            ], names=names)

        for b in batches:
            held, first, size = [], 0, 0
            for at, text in enumerate(b["text"]):
                held.append(np.array(encoder.encode(text.as_py() or "") + end, np.int32))
                size += len(held[-1])
                if size >= batch or at == len(b) - 1:
                    yield pieces(b["doc_id"].slice(first, len(held)), held)
                    held, first, size = [], at + 1, 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = pick(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, doc_tokens long, chunk int, place long, ids array<int>, length int"
    )
    rows.write.partitionBy("length").parquet(folder)


def read_sequences(spark: SparkSession, folder: str, kind: str = "long", longest: int = 2048) -> DataFrame:
    """sequence_id, doc_id (of type ``kind``), start, length, doc_tokens, offset (0) and ids of each sequence, from the files."""
    schema = f"doc_id {kind}, start long, doc_tokens long, chunk int, place long, ids array<int>, length int"
    rows = spark.read.schema(schema).parquet(folder)
    # one row for each writing task and length; the running sum takes the buckets one after another
    counts = rows.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    in_bucket = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("length").agg(F.sum("n").alias("n")).select(
        F.col("length").alias("_length"),
        F.coalesce(F.sum("n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_bucket"),
    )  # at most one row for each power of two
    starts = counts.select(
        F.col("length").alias("_length"), F.col("chunk").alias("_chunk"),
        F.coalesce(F.sum("n").over(in_bucket), F.lit(0)).alias("_before"),
    ).join(F.broadcast(buckets), "_length")
    joined = rows.join(
        small_side(starts, 32), (F.col("length") == F.col("_length")) & (F.col("chunk") == F.col("_chunk"))
    )
    return joined.select(
        (F.col("_bucket") + F.col("_before") + F.col("place")).alias("sequence_id"), "doc_id", "start",
        F.col("length").cast("long").alias("length"), "doc_tokens", F.lit(0).cast("long").alias("offset"), "ids",
    )


def packed(docs: DataFrame, path: str, longest: int = 2048, end_id: int | None = 1) -> DataFrame:
    """Pack all documents into files below the shared folder and read the sequences back."""
    folder = scratch_path(docs.sparkSession, "pieces")
    write_pieces(docs, path, folder, longest, end_id)
    return read_sequences(docs.sparkSession, folder, docs.schema["doc_id"].dataType.simpleString(), longest)


def with_crc32(sequences: DataFrame) -> DataFrame:
    """The sequences with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of the ids."""
    names = [c for c in sequences.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["ids"]
            flat = memoryview(ids.values.to_numpy().astype("<u4")).cast("B")
            ends = ids.offsets.to_numpy() * 4
            crc = np.fromiter((zlib.crc32(flat[i:j]) for i, j in zip(ends[:-1], ends[1:])), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(crc)], names=[*names, "ids_crc32"])

    fields = [f"{c} {sequences.schema[c].dataType.simpleString()}" for c in names]
    return sequences.mapInArrow(run, ", ".join([*fields, "ids_crc32 long"]))
