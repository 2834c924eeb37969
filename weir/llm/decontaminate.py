"""Benchmark decontamination by winnowing.

Of the 5-word hashes in each 10-word window the least is kept: a window's fingerprint. Two equal windows have equal
fingerprints, so every shared span of 10 words or more shares one, and neighbouring windows mostly share theirs.
Documents look their fingerprints up in a bitmap of the benchmark's (fixed size, no miss), the few that remain are
joined with the benchmark's fingerprints, and hits are extended to, and confirmed on, the exact words of the windows.
Items of fewer than 10 words are one window, fingerprinted by the hash of all its words; documents look up runs
of just those lengths. Only SQL functions are used.

Words: after lower-casing A-Z, runs of digits, letters a-z and anything beyond ASCII. Null and empty texts have no
words; an item without words hits nothing. Equal rows each get a result row; an empty benchmark hits nothing.
Other columns are ignored. The benchmark is broadcast only if its windows were counted to be few.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick, small_side, stored

WINDOW = 10
GRAM = 5
BITS = 1 << 18
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), NOT_WORD), "")


def gram(words: Column, i: Column, n: int) -> Column:
    """Hash of n words from place i (from 1)."""
    return F.xxhash64(*[F.element_at(words, i + k) for k in range(n)])


def fingerprints(words: Column) -> Column:
    """The least 5-word hash of each 10-word window; empty for fewer words."""
    def least(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(words) - WINDOW + 1),
            lambda i: F.least(*[F.element_at(hashes, i + k) for k in range(WINDOW - GRAM + 1)]),
        )

    places = F.sequence(F.lit(1), F.size(words) - GRAM + 1)
    return F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(
        let(F.transform(places, lambda i: gram(words, i, GRAM)), least)
    )


def short_grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: gram(words, i, n))
    )


def bit(mark: Column) -> Column:
    return F.pmod(F.xxhash64(mark), F.lit(BITS)).cast("int")


def bitmap(marks: DataFrame) -> Column:
    """A constant array of longs with a bit for each mark; of fixed size, whatever the number of marks."""
    rows = marks.select(bit(F.col("mark")).alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, b & 63)")).alias("bits")
    ).collect()
    filled = dict.fromkeys(range(BITS // 64), 0) | {r["word"]: r["bits"] for r in rows}
    return F.from_json(F.lit(json.dumps(list(filled.values()))), "array<bigint>")


def marked(bits: Column, mark: Column) -> Column:
    return let(bit(mark), lambda b: F.getbit(F.element_at(bits, F.shiftright(b, 6) + 1), b.bitwiseAND(63)) == 1)


def window_text(words: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """mark, window, n, items: each different window with the ids of all items that hold it."""
    rows = pick(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), words_of(F.col("text")).alias("words"))
    n = F.size("words")
    whole = F.array(F.struct(F.xxhash64("words").alias("mark"), F.array_join("words", " ").alias("window"), n.alias("n")))
    words = F.col("words")
    windows = F.transform(fingerprints(words), lambda m, i: F.struct(
        m.alias("mark"), window_text(words, i + 1, WINDOW).alias("window"), F.lit(WINDOW).alias("n")))
    listed = rows.where(n > 0).select("item_id", F.inline(F.when(n < WINDOW, whole).otherwise(windows)))
    short = F.coalesce(*[F.when(F.col("n") == k, gram(F.split("window", " "), F.lit(1), k)) for k in range(1, WINDOW)], "mark")
    return listed.withColumn("mark", F.when(F.col("n") < WINDOW, short).otherwise(F.col("mark"))).groupBy("mark", "window", "n").agg(
        F.array_sort(F.collect_set("item_id")).alias("items")
    )


def candidates(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, tag, n_words, and for each window whose fingerprint may be known: start, n, mark, window.

    Each document also has one row with start 0.
    """
    words = F.col("words")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), words_of(F.col("text")).alias("words"))
    found = []
    for (n,) in sorted(bench.select("n").distinct().collect()):  # at most ten lengths
        bits = bitmap(bench.where(F.col("n") == n))
        marks = fingerprints(words) if n == WINDOW else short_grams(words, n)
        tried = F.transform(marks, lambda m, i: F.when(marked(bits, m), F.struct((i + 1).alias("start"), F.lit(n).alias("n"), m.alias("mark"))))
        found.append(F.transform(F.filter(tried, lambda x: x.isNotNull()), lambda x: F.struct(
            x["start"].alias("start"), x["n"].alias("n"), x["mark"].alias("mark"), window_text(words, x["start"], x["n"]).alias("window"))))
    first = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("n"), F.xxhash64("doc_id", "tag").alias("mark"), F.lit("").alias("window")))
    return rows.select("doc_id", "tag", F.size("words").cast("long").alias("n_words"), F.inline(F.concat(first, *found)))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return hits(pick(docs, "doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text), n_words, n_hit and items (sorted) of each row."""
    bench = stored(benchmark_windows(benchmark), "benchmark-windows")
    size = bench.agg(F.count("*"), F.sum(F.octet_length("window") + F.size("items") * 16)).first()
    known = small_side(bench.select("mark", "window", "items"), 64 + (size[1] or 0) // max(1, size[0]), size[0])
    rows = candidates(docs, bench).join(known, ["mark", "window"], "left")
    rows = rows.where(F.col("items").isNotNull() | (F.col("start") == 0))
    each = rows.groupBy("doc_id", "tag", "n_words").agg(
        F.count(F.when(F.col("start") == 0, 1)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("start") > 0, F.struct("start", (F.col("start") + F.col("n")).alias("end"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )

    def cover(acc: Column, s: Column) -> Column:
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        )

    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), cover, lambda acc: acc["n"])
    return each.select(
        "doc_id", "tag", "n_words", covered.cast("long").alias("n_hit"), "items",
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no window hits.

    Contaminated rows are found again by doc_id, which may be null, and the hash of the text.
    """
    bad = stored(hits(pick(docs, "doc_id", "text"), benchmark).where("n_hit > 0").select(
        F.col("doc_id").alias("_bad_id"), F.col("tag").alias("_bad_tag")).distinct(), "contaminated")
    held = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"_c{docs.columns.index(n)}") for n in ("doc_id", "text"))
    same = (F.xxhash64(text) == F.col("_bad_tag")) & doc_id.eqNullSafe(F.col("_bad_id"))
    return held.join(small_side(bad, 24), same, "left_anti").toDF(*docs.columns)
