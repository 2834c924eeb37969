"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up every adjacent pair by binary search over the
sorted pair keys, finds the lowest rank of each word, and merges all its places at once; finished words leave.
A text is cut at single spaces first, where no word can reach across, and runs that were met before come from a
bounded cache. Runs with special tokens or with letters beyond the common ranges, on which Unicode versions differ,
go to the tokenizers library itself. Python is used as array rounds have no SQL form.

Texts: null counts as empty; an empty text has no ids. Memory is bounded by the texts and ids of one batch. Repeated
rows are encoded row by row, an empty table gives an empty one, and other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: The patterns by which the two kinds of vocabulary cut a text into words.
BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ENDED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Runs that are cut into words here; all others are left to the library.
BYTE_PLAIN = r"[\t\n\r\x20-\x7e\xa1-\u0220\u2010-\u2027]*+"
ENDED_PLAIN = r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*+"
#: White space that may stand beside a space; without it, and without double spaces, every space starts a run.
OTHER_SPACE = regex.compile(r"[\x00\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")
BETWEEN = regex.compile(r"(?<=[^\s\x1c-\x1f\u180e\u200b])(?= [^\s\x1c-\x1f\u180e\u200b])")
NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def gather(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[offsets[c]:offsets[c + 1]]`` of all codes behind one another, and their lengths."""
    starts = offsets[codes]
    lengths = offsets[codes + 1] - starts
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
    return flat[at], lengths


def offsets_of(lengths: Iterable[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, np.int64))]).astype(np.int64)


class RunCache:
    """Runs of text and their ids in one flat array. When it outgrows its bounds, runs met only once leave; if that
    isn't enough, all do."""

    def __init__(self, max_runs: int = 600_000, max_ids: int = 6_000_000):
        self.max_runs, self.max_ids = max_runs, max_ids
        self.index: dict[str, int] = {}
        self.set(np.zeros(0, np.int32), np.zeros(1, np.int64))

    def set(self, flat: np.ndarray, offsets: np.ndarray) -> None:
        self.flat, self.offsets, self.hits = flat, offsets, np.zeros(len(offsets) - 1, np.int64)

    def room(self) -> None:
        if len(self.index) <= self.max_runs and len(self.flat) <= self.max_ids:
            return
        keep = np.flatnonzero(self.hits > 1)
        if len(keep) > self.max_runs // 2 or self.offsets[keep + 1].sum() - self.offsets[keep].sum() > self.max_ids // 2:
            keep = keep[:0]
        flat, lengths = gather(self.flat, self.offsets, keep)
        names = list(self.index)
        self.index = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.set(flat, offsets_of(lengths))

    def add(self, runs: list[str], ids: np.ndarray, offsets: np.ndarray) -> None:
        n = len(self.index)
        self.index.update(zip(runs, range(n, n + len(runs))))
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
        self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
        self.hits = np.append(self.hits, np.zeros(len(runs), np.int64))


class Bpe:
    """Encoder and decoder of one BPE vocabulary of byte letters, with or without word ends."""

    def __init__(self, spec: str, batch_chars: int = 1_500_000):
        data = json.loads(spec)
        model, letters = data["model"], byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.spec, self.batch_chars, self.library = spec, batch_chars, None
        self.end = model.get("end_of_word_suffix") or ""
        added = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        if any(regex.search(r"\s", x) for x in added):
            raise ValueError("special tokens with white space are not supported")
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else regex.compile(r"(?!)")
        self.words = regex.compile(ENDED_WORDS if self.end else BYTE_WORDS)
        self.plain = regex.compile(ENDED_PLAIN if self.end else BYTE_PLAIN)
        size = max([*vocab.values(), *added.values()]) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in zip(*((a, b, a + b) for a, b in pairs)))
        self.size, self.made = size, made.astype(np.int32)
        order = np.argsort(left * size + right)
        self.keys, self.ranks = (left * size + right)[order], order.astype(np.int32)
        self.byte_ids, self.last_ids = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_ids[b], self.last_ids[b] = vocab[letter], vocab[letter + self.end]
        raw = [b""] * size
        for token, i in vocab.items():
            plain = token.removesuffix(self.end) if self.end else token
            raw[i] = bytes(letters[c] for c in plain) if all(c in letters for c in plain) else plain.encode()
            raw[i] += b" " if plain != token else b""
        for token, i in added.items():
            raw[i] = token.encode()
        self.bytes_flat, self.bytes_offsets = np.frombuffer(b"".join(raw), np.uint8), offsets_of(map(len, raw))
        self.cache = RunCache()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, flat, and offsets."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, last = self.byte_ids[raw], np.cumsum(lengths) - 1
        sym[last] = self.last_ids[raw[last]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            key = sym[:-1].astype(np.int64) * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[1:] == word[:-1])
            rank = np.append(np.where(known, self.ranks[at], NONE), NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            over = lowest == NONE
            if over.any():
                done.append((word[over], sym[over]))
                sym, word, rank, lowest = (x[~over] for x in (sym, word, rank, lowest))
            at = np.flatnonzero(rank == lowest)
            if not len(at):
                continue
            # of overlapping places, as in a run of one letter, every second one is merged
            run = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1] + 1), at, 0))
            at = at[(at - run) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done))
        return sym[np.argsort(word, kind="stable")], offsets_of(np.bincount(word, minlength=len(words)))

    def runs(self, text: str) -> list[str]:
        """Parts of the text that are encoded apart from one another."""
        if self.end:
            return text.replace("\n", " ").split(" ")
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or OTHER_SPACE.search(text):
            return BETWEEN.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def by_library(self, runs: list[str]) -> list[list[int]]:
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.library.no_truncation()
            self.library.no_padding()
        return [e.ids for e in self.library.encode_batch_fast(runs, add_special_tokens=False)]

    def learn(self, runs: list[str]) -> None:
        """Put the ids of new runs into the cache."""
        plain, rare = [], []
        together = "".join(runs)
        if self.plain.fullmatch(together) and "<" not in together:
            plain = runs
        for r in [] if plain else runs:
            (plain if self.plain.fullmatch(r) and not ("<" in r and self.special.search(r)) else rare).append(r)
        if plain:
            cut = self.words.findall
            words = [cut(unicodedata.normalize("NFC", r).lower() if self.end else r) for r in plain]
            place: dict[str, int] = {}
            order = np.array([place.setdefault(w, len(place)) for ws in words for w in ws], np.int64)
            ids, lengths = gather(*self.merge([w.encode() for w in place]), order)
            self.cache.add(plain, ids, offsets_of(lengths)[offsets_of(map(len, words))])
        if rare:
            ids = self.by_library(rare)
            self.cache.add(rare, np.array([i for x in ids for i in x], np.int32), offsets_of(map(len, ids)))

    def codes(self, runs: list[str]) -> np.ndarray:
        """Places of the runs in the cache."""
        known = self.cache.index.get
        codes = np.fromiter(map(known, runs, repeat(-1)), np.int64, len(runs))
        new = np.flatnonzero(codes < 0).tolist()
        if new:
            self.learn(list({runs[i] for i in new}))
            known = self.cache.index
            codes[new] = [known[runs[i]] for i in new]
        self.cache.hits += np.bincount(codes, minlength=len(self.cache.hits))
        return codes

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text; new runs of several texts are merged together."""
        out: list[np.ndarray] = []
        held: list[list[str]] = []
        chars = 0

        def flush() -> None:
            nonlocal held, chars
            self.cache.room()
            codes = self.codes([r for rs in held for r in rs])
            ids, lengths = gather(self.cache.flat, self.cache.offsets, codes)
            ends = np.append(0, np.cumsum(lengths))[offsets_of(map(len, held))]
            out.extend(ids[a:b] for a, b in zip(ends[:-1], ends[1:]))
            held, chars = [], 0

        for text in texts:
            held.append(self.runs(text))
            chars += len(text)
            if chars > self.batch_chars:
                flush()
        flush()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; ids outside the vocabulary are left out, broken UTF-8 is replaced."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < self.size)]
        return gather(self.bytes_flat, self.bytes_offsets, ids)[0].tobytes().decode("utf-8", "replace")


_LOADED: dict[tuple, Bpe] = {}
#: Texts that are encoded, and handed on, together; Spark bounds the bytes of a batch that comes in.
TOGETHER = 1000


def loaded(spec: str, kind: type[Bpe] = Bpe) -> Bpe:
    """One encoder for each vocabulary, kind of encoder and Python worker."""
    key = kind, hash(spec)
    if key not in _LOADED:
        _LOADED[key] = kind(spec)
    return _LOADED[key]


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), TOGETHER):
            yield b.slice(at, TOGETHER)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets_of(map(len, arrays)).astype(np.int32)), pa.array(flat, kind))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of each text with the vocabulary file at ``path``. doc_id is of any type."""
    spec = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for b in portions(batches):
            ids = bpe.encode(b["text"].to_pylist())
            n = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], n, lists(ids, pa.int32())], names=["doc_id", "n_tokens", "ids"])

    texts = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of each row with ``ids``."""
    spec = encoded.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for b in portions(batches):
            flat, ends = b["ids"].values.to_numpy(), b["ids"].offsets.to_numpy()
            texts = pa.array([bpe.decode(flat[i:j]) for i, j in zip(ends[:-1], ends[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = pick(encoded, "doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text)."""
    return decode_documents(encode_documents(docs, path), path).select(
        "doc_id", "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
