"""Spelling variants: words one edit apart, found by asymmetric chunks, and the more frequent form of each.

Of two words one edit apart, the shorter (or either, if they are equally long) is cut into two disjoint chunks, and the edit
leaves one of them whole. The other word has that chunk among its positional grams: at the same place, or one further if a
character was put in before it. So a word stands in two roles: as the shorter word it gives two chunks, and as the
other it gives the grams that lie where one edit can leave a chunk of a word as long as itself or one shorter.
Rows are joined by length, chunk number and chunk, and each pair is verified.

A chunk of very many words is refined, not dropped: the part beside it holds the one edit, so it is cut in two in turn, and
one of its halves stays whole as well, and so on down to single characters, where the words of a group are near
each other but for few. Each round counts its groups first, so none of more than ``group`` words is joined before.

Words are counted in tasks and summed by a shuffle (Python, as it is many times faster there than a row for each word);
the join is all DataFrame operations. A word's root is found by doubling the jumps along the forms, whose counts at
least double from step to step, so no more than a few rounds are needed.

Texts: null ones have no words; long ones are read whole, one at a time. Repeated rows count each. A row without doc_id has an
empty one where words are altered by ``planted``. Ties between near words of one count go to the first in code-point
order. An empty table gives no words. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lookups import lookup_join
from .common import pick, stored

#: What a text in Latin-1 becomes: letters (A-Z in lower case), and spaces for all else.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)
#: Different words that a task counts before it hands them on.
HELD = 400_000


def word_runs(text: str) -> list[bytes]:
    """Maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, in Latin-1, with A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def planted(doc_id: object, run: bytes, before: int) -> bytes:
    """The run, or in one of 97 cases by its hash, without one of its characters; ``before`` is the hash of the doc_id."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), before)
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, plant: bool = False, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """word, n of all words of at least so many characters and occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                # with at most one character removed, shorter runs stay too short
                words = Counter(w for w in word_runs(text.as_py() or "") if len(w) >= least_length)
                if plant:
                    i = doc_id.as_py()
                    before = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for w, n in words.items():
                        held[planted(i, w, before)] += n
                else:
                    held.update(words)
                if len(held) >= HELD:
                    yield rows()
                    held.clear()
        yield rows()

    counts = pick(docs, "doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.char_length("word") >= least_length) & (F.col("n") >= least_n))


def with_part(words: DataFrame) -> DataFrame:
    """The rows with the limits a and b of the part number ``at`` of ``parts`` of a word of length ``size``, and the key: what
    is left and right of the part. In the role of the longer word (``more`` = 1) the part is one character longer."""
    cut = lambda n: F.floor(F.col("size") * n / F.col("parts")).cast("int")
    rows = words.withColumns({"a": cut(F.col("at")), "b": cut(F.col("at") + 1)})
    left = F.col("word").substr(F.lit(1), F.col("a"))
    right = F.col("word").substr(F.col("b") + F.col("more") + 1, F.col("size"))
    return rows.withColumn("key", F.xxhash64("size", "parts", "at", left, right))


def one_edit(x: Column, y: Column) -> Column:
    return F.levenshtein(x, y, 1) == 1


def near_pairs(words: DataFrame, group: int = 32) -> DataFrame:
    """x, y: each pair of words (column ``word``, distinct) one edit apart, once; x is the shorter or, if equally long, the first."""
    role = lambda more: words.select("word", (F.char_length("word") - more).alias("size"), F.lit(more).alias("more"))
    # as the shorter word it has its own length, as the longer one that of the other
    roles = role(0).union(role(1)).where("size > 0")
    rows = stored(with_part(roles.withColumn("parts", F.lit(2)).withColumn("at", F.explode(F.array(F.lit(0), F.lit(1))))), "chunks")
    pairs = []
    while True:
        sizes = rows.groupBy("key").agg(
            F.count("*").alias("_rows"), F.sum(1 - F.col("more")).alias("_short"), F.max(F.col("b") - F.col("a")).alias("_width")
        ).where("_short > 0 AND _rows > 1").select(
            F.col("key").alias("_key"), ((F.col("_rows") > group) & (F.col("_width") > 1)).alias("_refine")
        )
        # groups of one word, and groups without a shorter word, leave here
        known = stored(lookup_join(rows, sizes, ["key"], ["_key"], "inner").drop("_key"), "chunks")
        ready = known.where("NOT _refine")
        short = ready.where("more = 0").select("key", F.col("word").alias("x"))
        other = ready.select(F.col("key").alias("_key"), F.col("word").alias("y"), "more")
        same = short.join(other, (F.col("key") == F.col("_key")) & ((F.col("more") == 1) | (F.col("x") < F.col("y"))) & one_edit(F.col("x"), F.col("y")))
        pairs.append(same.select("x", "y"))
        finer = known.where("_refine")
        if finer.isEmpty():
            break
        halves = finer.select("word", "size", "more", (2 * F.col("parts")).alias("parts"), F.explode(F.array(
            2 * F.col("at"), 2 * F.col("at") + 1)).alias("at"))
        rows = stored(with_part(halves).where("b > a"), "chunks")
    out = pairs[0]
    for p in pairs[1:]:
        out = out.union(p)
    # a pair whose edit fits in several places shares several chunks
    return out.distinct()


def with_roots(forms: DataFrame, doublings: int) -> DataFrame:
    """word, form and root of each word: the end of its chain of forms, which has less than 2^doublings steps."""
    at = stored(forms.select("word", "form", F.coalesce("form", "word").alias("root")), "roots")
    for _ in range(doublings):
        # only words that lead elsewhere are looked up
        ahead = at.where("root <> word").select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        at = stored(lookup_join(at, ahead, ["root"], ["_word"]).select(
            "word", "form", F.coalesce("_root", "root").alias("root")), "roots")
    return at


def spelling_variants(counts: DataFrame, ratio: int = 2, group: int = 32) -> DataFrame:
    """word, form, root, n, n_near, form_n of each counted word (columns word, n; distinct words).

    n_near is the number of words one edit apart; form is the most frequent of them (of several, the first in code-point
    order) if it has at least ``ratio`` (2 or more) times as many occurrences, form_n its number; root is the end of the chain of forms.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    counts = stored(counts.select("word", "n"), "words")
    pairs = stored(near_pairs(counts, group), "near")
    both = pairs.union(pairs.select("y", "x"))
    named = counts.select(F.col("word").alias("_word"), F.col("n").alias("_n"))
    near = lookup_join(both, named, ["y"], ["_word"], "inner")
    best = near.groupBy("x").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("less"), F.col("y").alias("word"))).alias("best")
    )
    joined = lookup_join(counts, best, ["word"], ["x"])
    form_n = -F.col("best.less")
    rows = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(form_n >= ratio * F.col("n"), F.col("best.word")).alias("form"),
        F.when(form_n >= ratio * F.col("n"), form_n).alias("form_n"),
    ), "forms")
    most = rows.agg(F.max("n")).first()[0] or 1
    # counts double at least along a chain, so it has at most log2(most) steps
    roots = with_roots(rows, most.bit_length().bit_length())
    found = roots.select(F.col("word").alias("_word"), "root")
    return lookup_join(rows, found, ["word"], ["_word"]).select("word", "form", "root", "n", "n_near", "form_n")
