"""Spelling variants against a comparison of all words."""

import collections
import re
import zlib

import pytest
from test_operators import SCHEMA, rows_of

from weir.llm.variants import near_pairs, spelling_variants, word_counts


def counted(rows, plant):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if plant and h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(n):
    out, form = {}, {}
    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    for w in n:
        them = [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if near(w, x)]
        best = min(them, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(them)
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] is not None else None))
    return rows


@pytest.mark.parametrize("group", [1, 32])
def test_near_pairs(spark, group):
    words = ["abcde", "abcdf", "abcd", "abcdef", "bcde", "xabcde", "axbcde", "aaaaa", "aaaaaa", "aaaa", "aabaaa", "éabcde", "z", "y", "zz"]
    words += [f"hot{a}{b}tail" for a in "abcdefgh" for b in "abcdefgh"] + ["hotatail", "hotabctail"]
    got = [tuple(r) for r in near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), group).collect()]
    assert len(got) == len(set(got))
    want = {frozenset((a, b)) for a in words for b in words if near(a, b)}
    assert {frozenset(p) for p in got} == want and all(len(x) <= len(y) for x, y in got)


@pytest.mark.parametrize("plant", [False, True])
def test_edges(spark, plant):
    texts = ["Receive receive RECEIVE recieve×3 receve receve receve receives " * 3, "Ünder ünder ünder Under under under", "naïve " * 7 + "naive " * 3]
    rows = rows_of() + [(i, t, *[None] * 6) for i, t in enumerate(texts * 2, 50)] + [(None, texts[0], *[None] * 6)]
    edge = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {tuple(r) for r in spelling_variants(word_counts(edge, plant)).collect()}
    assert got == expected(counted([r[:2] for r in rows], plant))


def test_chain(spark):
    # each has twice the occurrences of the one before: the root is the end of the chain
    chain = ["aaaaaaaaaa"[:10 - k] + "b" * k for k in range(9)]
    counts = spark.createDataFrame([(w, 3 << k) for k, w in enumerate(chain)] + [("lonely", 9)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling_variants(counts).collect()}
    assert got["aaaaaaaaaa"] == ("aaaaaaaaab", chain[-1], 1) and got[chain[-1]] == (None, chain[-1], 1)
    assert got["lonely"] == (None, "lonely", 0) and got[chain[3]] == (chain[4], chain[-1], 2)
    with pytest.raises(ValueError):
        spelling_variants(counts, ratio=1)


def test_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling_variants(word_counts(none)).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {tuple(r) for r in spelling_variants(word_counts(docs, True)).collect()}
    assert got == expected(counted([(r.doc_id, r.text) for r in docs.collect()], True))
