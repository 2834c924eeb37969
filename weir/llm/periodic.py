"""Periodic runs of words: harmonic grids of starts, longest common extensions by a difference cover.

A run is a stretch of words with smallest period p that is at least four times as long (and six words at least) and can't be
extended. Any run of period p holds a multiple x of 3 p for which x and x + p lie in it, so the grids of all periods,
n/3 + n/6 + … = O(n log n) pairs (x, x + p), meet every run. A pair of unequal words is dropped at once; for the others the
longest common extensions to both sides of x and x + p give the whole run, and what is too short for its period is dropped.

An extension compares words one by one only up to the places, at most V - 1 words on, where both sides reach the
difference cover: residues modulo V whose differences are all residues. Few pairs get that far. For the
documents of those that do, only the suffixes at covered places are sorted (by ranks of blocks of V words, doubling the
blocks), and the blocks that neighbours in that order share are kept in a sparse table of range minima. A minimum tells how
many whole blocks two places share, and the last words are compared again.

Documents are worked on in batches of a bounded number of words in tasks of ``mapInArrow``, with numpy, as suffix orders have
no SQL form; nothing is shuffled. A document longer than that is a batch of its own, so memory is bounded by the longest text.

Words are runs without ASCII white space. Null, empty and blank texts have no words and no runs. A document without doc_id
counts as one whose decimal doc_id is empty. Repeated rows are worked on row by row, an empty table gives an
empty one, and other columns are ignored. Of runs with equal exponents, the one that starts first is reported, then the
one of the smaller period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Modulus of the difference cover, its residues, and so the greatest number of words compared before a look-up.
V = 21
COVER = (0, 1, 6, 8, 18)
#: Grid pairs looked at together.
PAIRS = 1 << 22


def shift_table() -> np.ndarray:
    """For residues a and b: the least d for which a + d and b + d are both covered."""
    inside = np.isin(np.arange(V), COVER)
    at = (np.arange(V)[:, None, None] + np.arange(V)) % V
    both = inside[at] & inside[(np.arange(V)[None, :, None] + np.arange(V)) % V]
    return both.argmax(axis=2)


SHIFT = shift_table()


class Extensions:
    """Longest common extensions to the right of places of one array of words, by the covered suffixes alone."""

    def __init__(self, words: np.ndarray):
        self.words, n = words, len(words)
        inside = np.isin(np.arange(V), COVER)
        places = np.flatnonzero(inside[np.arange(n) % V])
        number = np.full(n + V, -1, np.int64)
        number[places] = np.arange(len(places))
        # rank of the block of V words at each covered place, then of twice as many blocks, and so on; -1 past the end
        rank = np.zeros(len(places), np.int64)
        padded = np.append(words.astype(np.int64), np.full(V, -1))
        for k in range(V):
            rank = np.unique(rank * (int(words.max(initial=0)) + 2) + padded[places + k] + 1, return_inverse=True)[1]
        self.levels, step = [rank], V
        while len(rank) and rank.max() + 1 < len(rank):
            after = places + step
            behind = np.where(after < n, number[np.minimum(after, n - 1)], -1)
            rank = np.unique(rank * (len(rank) + 1) + np.where(behind >= 0, rank[behind], -1) + 1, return_inverse=True)[1]
            self.levels.append(rank)
            step *= 2
        self.number, self.rank = number, rank
        order = np.argsort(rank, kind="stable")
        shared = self.blocks(places[order[:-1]], places[order[1:]])
        self.minima = [shared]
        while len(self.minima[-1]) > (width := 1 << (len(self.minima) - 1)):
            self.minima.append(np.minimum(self.minima[-1][:-width], self.minima[-1][width:]))

    def blocks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal blocks of V words at covered places a and b, by the ranks of the doubling rounds, the longest first."""
        out, n = np.zeros(len(a), np.int64), len(self.words)
        a, b = a.copy(), b.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = (a < n) & (b < n)
            i, j = self.number[np.minimum(a, n - 1)], self.number[np.minimum(b, n - 1)]
            same = fits & (self.levels[k][i] == self.levels[k][j])
            out += same << k
            a, b = a + same * (V << k), b + same * (V << k)
        return out

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whole blocks that the suffixes at covered places a != b share: the least of their neighbours' between them."""
        i, j = self.rank[self.number[a]], self.rank[self.number[b]]
        i, j = np.minimum(i, j), np.maximum(i, j)
        k = np.log2(j - i).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            at = k == level
            row = self.minima[level]
            out[at] = np.minimum(row[i[at]], row[j[at] - (1 << level)])
        return out

    def further(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of covered places a and b."""
        out = self.lookup(a, b) * V
        return out + compare(self.words, a + out, b + out, np.full(len(a), V, np.int64))


def compare(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal words from a and b on, word by word, at most ``most`` of them."""
    out, n, left = np.zeros(len(a), np.int64), len(words), np.arange(len(a))
    for step in range(int(most.max(initial=0))):
        left = left[(most[left] > step) & (a[left] + step < n) & (b[left] + step < n)]
        left = left[words[a[left] + step] == words[b[left] + step]]
        if not len(left):
            break
        out[left] += 1
    return out


def grids(lengths: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All grid pairs of documents of these lengths: document, place x in it (a multiple of three periods), period.

    They come in portions of about ``most`` pairs.
    """
    periods = lengths // LEAST_EXPONENT
    doc = np.repeat(np.arange(len(lengths)), periods)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    step = (LEAST_EXPONENT - 1) * period
    counts = -(-(lengths[doc] - period) // step)
    portion = (np.cumsum(counts) - counts) // most
    cuts = np.append(np.flatnonzero(np.diff(portion, prepend=-1)), len(doc))
    for i, j in zip(cuts[:-1], cuts[1:]):
        n = counts[i:j]
        row = np.repeat(np.arange(i, j), n)
        yield doc[row], (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step[row], period[row]


def extensions(words: np.ndarray, owner: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common extension to the right of places a and b, which lie in one document each; ``owner`` is the document of a word.

    ``words`` must differ between documents at their ends (there are separators).
    """
    out = compare(words, a, b, np.full(len(a), V, np.int64))
    far = np.flatnonzero(out == V)
    if not len(far):
        return out
    # an array of the documents that are needed only
    docs = np.unique(owner[a[far]])
    ends = np.append(starts[1:], len(words))[docs]
    lengths = ends - starts[docs]
    first = np.cumsum(lengths) - lengths
    part = words[np.repeat(starts[docs] - first, lengths) + np.arange(lengths.sum())]
    moved = first[np.searchsorted(docs, owner[a[far]])] - starts[owner[a[far]]]
    i, j = a[far] + moved, b[far] + moved
    covers = Extensions(np.unique(part, return_inverse=True)[1])
    shift = SHIFT[i % V, j % V]  # these words are equal, as V words are
    out[far] = shift + covers.further(i + shift, j + shift)
    return out


def runs(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of documents whose words (as numbers from 0) lie behind one another: document, start, length, period, sorted."""
    # a separator of its own behind each document
    top = int(words.max(initial=-1)) + 1
    ends = np.cumsum(lengths)
    text = np.insert(words, ends, top + np.arange(len(lengths)))
    starts = ends - lengths + np.arange(len(lengths))
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    seeds = [(np.zeros(0, np.int64),) * 3]
    for doc, place, period in grids(lengths, PAIRS):
        x = starts[doc] + place
        same = text[x] == text[x + period]
        seeds.append((doc[same], x[same], period[same]))
    doc, x, period = (np.concatenate(c) for c in zip(*seeds))
    right = extensions(text, owner, starts, x, x + period)
    # to the left: the mirrored text, whose documents come in reverse, each led by its separator
    size = len(text)
    mirrored_owner = len(lengths) - 1 - owner[::-1]
    mirrored_starts = size - starts[::-1] - (lengths[::-1] + 1)
    # a run needs (LEAST_EXPONENT - 1) periods of agreement, of which one side may have all
    left = extensions(text[::-1], mirrored_owner, mirrored_starts, size - 1 - x, size - 1 - x - period) - 1
    length = left + right + period
    enough = length >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
    doc, start, length, period = doc[enough], (x - left - starts[doc])[enough], length[enough], period[enough]
    order = np.lexsort((period, length, start, doc))
    doc, start, length, period = doc[order], start[order], length[order], period[order]
    # periods of one stretch are multiples of the smallest, which is found as well
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    doc, start, length, period = doc[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, doc))
    return doc[order], start[order], length[order], period[order]


def split(text: bytes | None) -> list[bytes]:
    """The words of a text; bytes know ASCII white space only."""
    return (text or b"").split()


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by hash of the doc_id, with their words from some place on made periodic."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def found(held: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, length and period of the runs of each document, by start, then period."""
    lengths = np.array([len(w) for w in held], np.int64)
    number: dict[bytes, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for ws in held for w in ws), np.int64, int(lengths.sum()))
    doc, *columns = runs(words, lengths)
    ends = np.searchsorted(doc, np.arange(len(held) + 1))
    for i, j in zip(ends[:-1], ends[1:]):
        yield tuple(c[i:j] for c in columns)


def kept_words(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words without those that a run repeats, that is has after its first period."""
    if not len(start):
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def batched(rows: DataFrame, made: dict[str, pa.DataType], schema: str, of, plant: bool, batch_words: int) -> DataFrame:
    """doc_id and the columns that ``of`` makes of the words and runs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, first, size = [], 0, 0
            for at, (doc_id, text) in enumerate(zip(b["doc_id"], b["text"])):
                words = split(text.as_py())
                held.append(planted(doc_id.as_py(), words) if plant else words)
                size += len(words)
                if size >= batch_words or at == len(b) - 1:
                    values = zip(*(of(w, *r) for w, r in zip(held, found(held))))
                    columns = [pa.array(v, kind) for v, kind in zip(values, made.values())]
                    yield pa.RecordBatch.from_arrays([b["doc_id"].slice(first, len(held)), *columns], names=["doc_id", *made])
                    held, first, size = [], at + 1, 0

    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = pick(rows, "doc_id", "text").selectExpr("doc_id", "cast(text AS binary) AS text")
    return texts.mapInArrow(run, f"doc_id {kind}, {schema}")


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, plant: bool = False, batch_words: int = 500_000) -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period in words, by start, then period) and collapsed: the words
    that no run repeats, joined by one space. With ``plant``, a tenth of the documents is made periodic first (``planted``).
    """

    def of(words, start, length, period):
        stretches = [{"start": s, "length": n, "period": p} for s, n, p in zip(start.tolist(), length.tolist(), period.tolist())]
        return len(words), stretches, b" ".join(kept_words(words, start, length, period)).decode("utf-8", "replace")

    made = {"n_words": pa.int64(), "runs": RUN, "collapsed": pa.string()}
    schema = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return batched(docs, made, schema, of, plant, batch_words)


def digests(found_runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run of greatest exponent (nulls without runs),
    runs_sha256 and collapsed_sha256, from the result of ``periodic_runs``."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for stretches, text in zip(b["runs"].to_pylist(), b["collapsed"]):
                # quotients of whole numbers below 2^26 are equal as doubles only if they are equal
                best = min(stretches, key=lambda r: (-r["length"] / r["period"], r["start"], r["period"]), default=None)
                lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in stretches)
                rows.append((
                    len(stretches), *((best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"])
                                      if best else (None,) * 4),
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.as_buffer() or b"").hexdigest(),
                ))
            columns = zip(*rows) if rows else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    kind = found_runs.schema["doc_id"].dataType.simpleString()
    return found_runs.select("doc_id", "runs", "collapsed").mapInArrow(run, (
        f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    ))
