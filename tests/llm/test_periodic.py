"""Periodic runs against a search of all periods, and the extensions against direct comparison."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from test_operators import SCHEMA, rows_of

from weir.llm import periodic
from weir.llm.periodic import COVER, SHIFT, Extensions, V, digests, found, periodic_runs


def all_runs(w):
    """Stretches of period p, by increasing p, so that the smallest period of a stretch comes first."""
    out = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def made_periodic(i, w):
    h = zlib.crc32(("" if i is None else str(i)).encode())
    if h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]


def row(i, text):
    w = made_periodic(i, (text or "").encode().split())
    runs = all_runs(w)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    best = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]), default=None)
    start = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *start, sha(lines.encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_cover():
    for a in range(V):
        for b in range(V):
            assert (a + SHIFT[a, b]) % V in COVER and (b + SHIFT[a, b]) % V in COVER


def test_extensions():
    rng = np.random.default_rng(3)
    for n, k in ((1, 1), (V, 1), (300, 1), (300, 2), (1000, 3)):
        words = rng.integers(0, k, n)
        words[n // 2:] = words[:n - n // 2]
        at = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
        a, b = rng.choice(at, 200), rng.choice(at, 200)
        a, b = a[a != b], b[a != b]
        if not len(a):
            continue
        for i, j, x in zip(a, b, Extensions(words).further(a, b)):
            most = n - max(i, j)
            differ = np.flatnonzero(words[i:i + most] != words[j:j + most])
            assert x == (differ[0] if len(differ) else most)


def test_runs(monkeypatch):
    rng = random.Random(1)
    for pairs in (periodic.PAIRS, 40):
        monkeypatch.setattr(periodic, "PAIRS", pairs)
        for _ in range(60):
            docs = []
            for _ in range(rng.randrange(1, 6)):
                k, n = rng.choice([1, 2, 3, 50]), rng.choice([0, 1, 5, 6, 7, 30, 200, 500])
                w = [rng.randrange(k) for _ in range(n)]
                if rng.random() < 0.6 and n:
                    a = rng.randrange(n)
                    p = 1 + (n - a) // rng.randrange(2, 12)
                    w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
                docs.append([b"%d" % x for x in (w + [1] * rng.randrange(9) + w if rng.random() < 0.3 else w)])
            for d, columns in zip(docs, found(docs)):
                assert list(zip(*(c.tolist() for c in columns))) == all_runs(d)


@pytest.mark.parametrize("batch_words", [1, 500_000])
def test_documents(spark, batch_words):
    extra = ["a b " * 30, "x x x x x x", "x x x x x", "p q r\tp q r\x0cp q r p q r\u00a0p q r", "é é é é é é é ü ü ü ü ü ü ü"]
    rows = rows_of() + [(100 + i, t, *[None] * 6) for i, t in enumerate(extra * 8)] + [(-1, "to be or not " * 9, *[None] * 6)]
    edge = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in digests(periodic_runs(edge, True, batch_words)).collect()]
    assert sorted(got, key=str) == sorted((row(i, t) for i, t, *_ in rows), key=str)
    plain = {r.doc_id: r for r in periodic_runs(edge, False, batch_words).collect() if r.doc_id is not None}
    assert [tuple(x) for x in plain[100].runs] == [(0, 60, 2)] and plain[100].collapsed == "a b" and plain[3].collapsed == ""
    assert digests(periodic_runs(spark.createDataFrame([], SCHEMA))).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r) for r in digests(periodic_runs(docs, True)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text) < 8000}
    assert texts and all(got[i] == row(i, t) for i, t in texts.items())
