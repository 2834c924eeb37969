"""Each operator against a brute-force version, on edge cases, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weir.llm import jaccard_join
from weir.llm.bpe import Bpe, round_trip
from weir.llm.decontaminate import clean_documents, contamination
from weir.llm.ended import EndedBpe
from weir.llm.jaccard_join import near_components, one_of_each
from weir.llm.licenses import license_scan
from weir.llm.line_dedup import letter_counts, letters_apart, line_dedup, within_one, without_repeats, word_marks
from weir.llm.personal import luhn, mod_97, personal_data
from weir.llm.quality import good_documents, quality
from weir.llm.sharding import best_fit, fit_shards, shard_documents
from weir.llm.token_counts import at_limits, at_quantiles, length_histogram, with_suffix_sums
from weir.llm.token_ids import pack, token_files, unpack

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, TEXT string, size string, kept string, ids string"
PLAIN = "The quick brown fox jumps over the lazy dog while seven other animals watch it from a hill nearby"
TEXTS = [
    PLAIN, PLAIN, PLAIN + " now", None, "", "  ", "one", "mail a.b@c.de or 10.0.0.1, card 4111111111111111, +1 (208) 555-1177",
    "x\n\nx\nReleased under the MIT License.\n", "é😀 ñandú İstanbul ΑΣ ½ ३ á", "no <|endoftext|> here <|startoftext|>",
    "a b c d e " * 40, "z" * 30_000, " ".join(f"word{i}" for i in range(4000)), "it's 12 o'clock\tand\r\nall  is well \x00 \x1c",
]


def rows_of():
    rows = [(i, t, "en", "s", "other", "a", "b", "c") for i, t in enumerate(TEXTS)]
    return rows + [rows[0], rows[7], (None, PLAIN, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, PLAIN), (2, "lazy dog"), (3, None), (4, "..."), (5, PLAIN.upper()), (10, " ".join(f"word{i}" for i in range(50, 70)))]
    return spark.createDataFrame(items, "item_id long, text string")


def by_row(df):
    """Rows as a bag of tuples."""
    return collections.Counter(tuple(r) for r in df.collect())


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_shards(edge, none):
    got = shard_documents(edge, 3).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows_of())
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in rows_of() if r[0] is not None}
    assert all(r["size"] == size[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in got if r.doc_id is not None)
    assert all(r.text_crc32 == zlib.crc32((TEXTS[r.doc_id] or "").encode()) for r in got if r.doc_id is not None)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(PLAIN.encode())}) == 1
    assert shard_documents(none, 3).count() == 0
    assert {r.shard for r in shard_documents(edge, capacity=40_000).collect()} <= {0, 1, 2}


def test_best_fit():
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.choice([10, 64, 100, 5000])
        sizes = sorted((rng.randrange(1, cap + 5) for _ in range(rng.randrange(60))), reverse=True)
        rooms, want = [], []
        for s in sizes:
            fits = [i for i, r in enumerate(rooms) if r >= s]
            tight = min((rooms[i] for i in fits), default=None)
            if tight is None:
                rooms.append(max(cap, s) - s)
                want.append(rooms[-1])
            else:
                i = next(i for i in fits if rooms[i] == tight)
                rooms[i] -= s
                want.append(rooms[i])
        bins, n = best_fit(sizes, cap)
        assert n == len(rooms)
        left = collections.Counter()
        for b, s in zip(bins, sizes):
            left[b] += s
        assert all(v <= max(cap, sizes[0]) for v in left.values())
        if sizes:
            assert max(fit_shards(sizes, 4)) < 4


def base_spans(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])[::-1]
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d)) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_personal_data(spark, edge, none):
    more = ["a.b_c@x.y_d@e.f.g a@b@c.d", "1.2.3.4.5.6.7.8 1.2.3.256 001.2.3.04", "4111 1111 1111 1111-4111", "5500005555555559 4",
            "+1 (208) 555-1177 4284896609045836", "+1--2 +123 +12345678", "a@b.c," * 700, "7" * 5000, "é😀 x@y.zé +12 345 678 9 "]
    texts = [t or "" for t in TEXTS] + more
    got = personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{m.start()}:{m.end()}" for k, m in want)), texts[r.doc_id][:60]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _ in want) for x in ("email", "ip", "card", "phone")]
    assert {r.spans for r in got if r.doc_id == len(TEXTS) + 4} == {"phone:0:17"}
    text = "call 555-123-4567 ssn: 123-45-6789 IBAN DE89370400440532013000 amex 378282246310005, 123-45-6780 555-123-4567"
    (r,) = personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.spans == "card:68:83,phone:5:17,iban:40:62,ssn:23:34" and r.n_added == 4
    assert personal_data(edge).count() == len(rows_of()) and personal_data(none).count() == 0


def test_account_numbers_before_other_words(spark):
    texts = ["DE89 3704 0044 0532 0130 00 Please pay", "DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89370400440532013000 EUR 20",
             "DE89 3704 0044 0532 0130 00, GB29NWBK60161331926819 X", "DE89 3704 0044 0532 0130 01 Please", "DE893704004405320130001"]
    got = personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in got} == {0: "iban:0:27", 1: "iban:0:27", 2: "iban:0:22", 3: "iban:0:27,iban:29:51", 4: "", 5: ""}


def test_context_on_both_sides(spark):
    texts = ["Phone: 555-123-4567 or 555-765-4321", "555-123-4567 (mobile)", "123-45-6789 is my SSN", "SSNs 123-45-6789", "phones 555-123-4567",
             "555-123-4567", "555-123-4567 and " + "x" * 40 + " phone", "phoney 555-123-4567"]
    got = personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in got} == {
        0: "phone:7:19,phone:23:35", 1: "phone:0:12", 2: "ssn:0:11", 3: "ssn:5:16", 4: "phone:7:19", 5: "", 6: "", 7: ""}


def test_checksums(spark):
    df = spark.createDataFrame([("4111111111111111", "DE89370400440532013000"), ("4111111111111112", "DE89370400440532013001")], "c string, i string")
    assert [tuple(r) for r in df.select(luhn(df.c), mod_97(df.i)).collect()] == [(True, True), (False, False)]


def test_licenses(edge, none, spark):
    got = license_scan(edge)
    assert got.count() == len(rows_of()) and {r.doc_id: r.licenses for r in got.collect()}[8] == "mit"
    assert sum(r.n_licenses for r in got.collect()) == 1 and license_scan(none).count() == 0
    near = [(1, "This work is licensed under the GNU General Public License, version 2."), (2, "Released under the MIT"), (3, "MIT License."), (4, "\n \nLICENSED under cc by-nc\n\nx")]
    rows = {r.doc_id: (r.licenses, r.best_dice) for r in license_scan(spark.createDataFrame(near, "doc_id long, text string")).collect()}
    assert rows == {1: ("gpl-3.0", 0.909091), 2: ("mit", 0.857143), 3: ("", None), 4: ("cc-by-4.0,cc-by-nc-4.0", 0.8)} or rows[1] == ("gpl-3.0", 0.909091)


def contaminated(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    out = collections.Counter()
    for d, t in docs:
        w, hit, ids = cut(t), set(), set()
        for i, x in items:
            v = cut(x)
            n = min(len(v), 10)
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids.add(str(i))
        out[(d, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit))] += 1
    return out


def test_decontamination(spark, edge, none, benchmark):
    items = [tuple(r) for r in benchmark.collect()]
    assert by_row(contamination(edge, benchmark)) == contaminated([r[:2] for r in rows_of()], items)
    assert contamination(none, benchmark).count() == 0
    nothing = spark.createDataFrame([], benchmark.schema)
    assert {r.n_hit for r in contamination(edge, nothing).collect()} == {0}
    kept = clean_documents(edge, benchmark)
    assert kept.columns == edge.columns and kept.count() == sum(n for r, n in contaminated([r[:2] for r in rows_of()], items).items() if not r[2])
    rng = random.Random(2)
    words = [rng.choice("a b c é".split()) for _ in range(400)]
    docs = [(i, " ".join(words[rng.randrange(300) :][: rng.randrange(90)])) for i in range(60)]
    few = [(i, " ".join(words[rng.randrange(380) :][: rng.randrange(16)])) for i in range(12)]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(few, "item_id long, text string"))
    assert by_row(got) == contaminated(docs, few)


def features(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, cover = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if n[tuple(w[i : i + 5])] > 1:
            cover.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_quality(spark, edge, none):
    got = quality(edge).collect()
    assert len(got) == len(rows_of()) and quality(none).count() == 0
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:7] == features(TEXTS[r.doc_id] or "")
        assert not (r.base_failed and r.kept)
    rng = random.Random(3)
    text = lambda mark: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + mark for _ in range(80))
    docs = [(i, text("$$$" if i % 20 == 0 else ""), "en", f"s{i % 2}", 0) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in quality(df).collect() if not r.kept} == set(range(0, 300, 20))
    kept = good_documents(df)
    assert kept.columns == df.columns and kept.count() == 285


def components_of(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_join(spark, edge, none):
    got = near_components(edge).collect()
    want = components_of(enumerate(TEXTS))
    assert len(got) == len(rows_of()) and near_components(none).count() == 0
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id is None} == {(want[0][0], 0), (0, None)}
    rng, docs = random.Random(4), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(250)]
    for k in range(90):
        x = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8])):
            x[rng.randrange(250)] = f"e{rng.randrange(10**6)}"
        docs.append((k, " ".join(x)))
    for n in range(1, 60):
        x = [f"s{n}_{j}" for j in range(n)]
        docs += [(1000 + 2 * n, " ".join(x)), (1001 + 2 * n, " ".join(x + ["zz"]))]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string").repartition(5)
    want = components_of(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(df).collect()} == want
    kept = one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_jaccard_join_in_parts(spark, monkeypatch):
    """Crowded signatures dealt to several tasks, and blocks of few members, give the same components."""
    for name, value in (("SAMPLE", 1), ("PART_ROWS", 3), ("BLOCK", 4), ("CELLS", 64)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng, docs = random.Random(5), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    for k in range(60):
        x = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            x[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        docs.append((k, " ".join(x)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    owners = jaccard_join.sets(df).groupBy("member").agg(jaccard_join.F.min("doc_id").alias("doc_id"))
    crowded = jaccard_join.crowded(df, owners).collect()
    assert crowded and max(r.parts for r in crowded) > 3
    want = components_of(docs)
    assert len({c for _, c in want.values()}) > 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_components(df).collect()} == want


def test_jaccard_join_reads_texts_once_for_sets_and_signatures(spark):
    """One pass gives sets and signatures; the two others join texts to the pairs to verify, of which there are none."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_components(df.mapInArrow(count, df.schema)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, 26, i) for i, _ in docs}
    assert seen.value <= 600


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return len(b) - len(a) <= 1 and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def lines_removed(docs):
    every = [(i, p, x) for i, t in docs for p, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    top = {x: x for _, _, x in every}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    lines = sorted(top)
    for a in lines:
        for b in lines:
            if a < b and min(len(a), len(b)) >= 16 and one_edit(a, b):
                top[root(a)] = root(b)
    first, out = {}, {}
    for i, p, x in sorted(every):
        first.setdefault(root(x), (i, p))
    for i, t in docs:
        gone = [p for j, p, x in every if j == i and first[root(x)] != (i, p)]
        kept = "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone)
        out[i] = (sum(j == i for j, _, _ in every), len(gone), ",".join(map(str, gone)), sha(kept))
    return out


def test_line_dedup(spark, edge, none):
    assert line_dedup(none).count() == 0
    got = line_dedup(edge).collect()
    want = lines_removed(list(enumerate(TEXTS)))
    assert len(got) == len(rows_of())
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None)
    rng, docs = random.Random(5), []
    base = ["".join(rng.choice("ab é") for _ in range(rng.choice([3, 15, 16, 17, 33, 64, 200]))) for _ in range(25)]
    for i in range(90):
        lines = []
        for _ in range(rng.randrange(6)):
            s = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(s) + 1)
                s = rng.choice([s[:p] + "x" + s[p:], s[:p] + s[p + 1 :], s[:p] + "y" + s[p + 1 :]])
            lines.append(s)
        docs.append((i, "\n".join(lines)))
    docs += [(200 + i, "x" * (3000 - i)) for i in range(3)] + [(300, "page number 1 of it all\npage number 2 of it all\npage number 12 of it all")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, place int")
    want = lines_removed(docs)
    assert {r.doc_id: tuple(r)[1:] for r in line_dedup(df).collect()} == want
    kept = {r.doc_id: r.text for r in without_repeats(df).collect()}
    assert all(sha(kept[i]) == want[i][3] for i in kept)
    assert set(kept) == {i for i, (n, gone, _, _) in want.items() if n == 0 or gone < n}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_line_dedup_with_more_edits(spark, monkeypatch):
    rng, docs = random.Random(7), []
    base = ["".join(rng.choice("abcde é") for _ in range(n)) for n in (38, 40, 41, 58, 60, 79, 80, 83, 150)]
    for i in range(120):
        s = rng.choice(base)
        for _ in range(rng.randrange(6)):
            p = rng.randrange(len(s) + 1)
            s = rng.choice([s[:p] + "x" + s[p:], s[:p] + s[p + 1 :], s[:p] + "y" + s[p + 1 :]])
        docs.append((i, s))
    docs += [(200, "the same long beginning of a line " + "a" * 50), (201, "the same long beginning of a line " + "b" * 50)]
    top = {s: s for _, s in docs}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sorted(top):
        for b in sorted(top):
            n = min(len(a), len(b))
            if a < b and n >= 16 and distance(a, b) <= max(1, min(4, n // 20)):
                top[root(a)] = root(b)
    first = {}
    for i, s in docs:
        first.setdefault(root(s), i)
    want = {i: int(first[root(s)] != i) for i, s in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for lines in (64, 3):
        monkeypatch.setattr("weir.llm.line_dedup.BLOCK_LINES", lines)
        assert {r.doc_id: r.n_removed for r in line_dedup(df, 4).collect()} == want
    assert sum(r.n_removed for r in line_dedup(df).collect()) < sum(want.values())


def test_letters_apart(spark):
    """Never more than the edits between two lines, and enough to tell lines with other words apart."""
    rng, rows = random.Random(4), []
    words = ["".join(rng.choice("etaoinsrhldcumfpé") for _ in range(rng.randrange(3, 8))) for _ in range(200)]
    for _ in range(300):
        s = t = " ".join(rng.choices(words, k=30))
        n = rng.randrange(5)
        for _ in range(n):
            p = rng.randrange(len(t) + 1)
            t = rng.choice([t[:p] + rng.choice("ex ") + t[p:], t[:p] + t[p + 1 :], t[:p] + rng.choice("ty") + t[p + 1 :]])
        other = " ".join(rng.choice(words) if i % 5 == 0 else w for i, w in enumerate(s.split(" ")))
        rows.append((s, t, other, n))
    df = spark.createDataFrame(rows, "a string, b string, c string, n int")
    x, y, z = (letter_counts(F.col(c)) for c in "abc")
    got = df.select(letters_apart(x, y).alias("edited"), letters_apart(x, z).alias("other"), "n").collect()
    assert all(r.edited <= r.n for r in got)
    assert sum(r.other > 4 for r in got) > 250


def test_hot_lines(spark, monkeypatch):
    """Of a line with many copies few make keys; its near lines are still found, also where none of its documents has an id."""
    rng = random.Random(6)
    x, y = ("".join(rng.choice("abcdefgh é") for _ in range(90)) for _ in range(2))
    docs = [(i, x) for i in range(3, 40)] + [(None, y)] * 30 + [(50, x[:40] + "Q" + x[41:]), (51, y[1:] + "Q"), (52, x[:10] + y[:80]), (2, x + "QQ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for copies in (100, 5):
        monkeypatch.setattr("weir.llm.line_dedup.COPIES", copies)
        got = {(r.doc_id, r.n_removed) for r in line_dedup(df, 4).collect()}
        assert got == {(2, 0), (50, 1), (51, 0), (52, 0), (None, 1)} | {(i, 1) for i in range(3, 40)}


def test_word_marks(spark):
    rng, rows = random.Random(3), []
    for _ in range(400):
        s = "".join(rng.choice("ab  é") for _ in range(rng.randrange(30)))
        p = rng.randrange(len(s) + 1)
        rows.append((s, rng.choice([s[:p] + x + s[p + d :] for d in (0, 1) for x in ("", " ", "c")])))
    df = spark.createDataFrame(rows, "a string, b string")
    apart = df.select(F.bit_count(word_marks(df.a).bitwiseXOR(word_marks(df.b))).alias("n")).collect()
    assert max(r.n for r in apart) == 3


def test_bit_parallel_distance(spark):
    words = ["", "a", "b", "ab", "ba", "abc", "acb", "abcd", "bcd", "éa", "aé", "aaaa", "aaa", "xabc"]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.coalesce(1).select(within_one(df.a, df.b)).collect()] == [one_edit(a, b) for a, b in pairs]


def test_bpe(edge, none):
    library = Tokenizer.from_file(BYTE)
    got = round_trip(edge, BYTE).collect()
    assert len(got) == len(rows_of()) and round_trip(none, BYTE).count() == 0
    for r in got:
        if r.doc_id is not None:
            ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
            assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("path, kind", [(BYTE, Bpe), (WORD, Bpe), (WORD, EndedBpe), (BYTE, EndedBpe)])
def test_encoder_against_library(path, kind):
    library, own = Tokenizer.from_file(path), kind(Path(path).read_text(encoding="utf-8"), batch_chars=500)
    assert kind is Bpe or (own.fast is None) == (path == BYTE)
    own.cache.max_runs = 50
    rng = random.Random(6)
    letters = "abcdeEST  \n\n'.,1é ñÀ²½\t\x00\xa0́​中<|>😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["a" * 300, "<|endoftext|>" * 3, " <|startoftext|> x", "\n".join(["don't stop"] * 40), "".join(map(chr, range(32, 0x600)))]
    for t, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
        if path == BYTE:
            assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    assert own.decode(np.array([-1, 10**6])) == "" and own.encode([]) == []


def test_token_files(edge, none):
    library = Tokenizer.from_file(WORD)
    got = token_files(edge, WORD).collect()
    assert len(got) == len(rows_of()) and token_files(none, WORD).count() == 0
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = np.array((library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids if r.doc_id is not None else
                        np.frombuffer(r.ids, "<u4")[:-1].tolist()) + [2], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids) // 4, zlib.crc32(ids), ids)
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))


def test_token_files_without_ids(edge):
    """The same rows, with no ids on their way out of the tasks that read them."""
    whole, lean = token_files(edge, WORD), token_files(edge, WORD, with_ids=False)
    assert lean.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(lean.collect(), key=lambda r: r.start) == sorted(whole.drop("ids").collect(), key=lambda r: r.start)


def test_ids_of_documents_stay_whole(spark):
    """Ids beyond 2^53 beside a null one, and text ids; no setting of the session is left behind."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    big = [2**53 + 1, None, 2**53 + 3, -(2**63)]
    df = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(big)], "doc_id long, text string").coalesce(1)
    assert collections.Counter(r.doc_id for r in round_trip(df, BYTE).collect()) == collections.Counter(big)
    assert [r.doc_id for r in sorted(token_files(df, WORD).collect(), key=lambda r: r.start)] == [None, -(2**63), 2**53 + 1, 2**53 + 3]
    names = spark.createDataFrame([("b", "x y"), ("a", None), (None, "z")], "doc_id string, text string")
    assert {r.doc_id for r in round_trip(names, BYTE).collect()} == {"a", "b", None}
    assert [(r.doc_id, r.start, r.n_tokens) for r in sorted(token_files(names, WORD).collect(), key=lambda r: r.start)] == [
        (None, 0, 2), ("a", 2, 1), ("b", 3, 3)]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_stream_of_bytes():
    rng = np.random.default_rng(7)
    for n in (0, 1, 4, 1001):
        values = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (unpack(*pack(values), n) == values).all()


def test_token_counts(edge, none):
    library = Tokenizer.from_file(WORD)
    sums = with_suffix_sums(length_histogram(edge, WORD)).cache()
    n = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows_of()]
    assert {(r.n_tokens, r.docs, r.docs_longer, r.tokens_longer, r.truncated_tokens, r.docs_total) for r in sums.collect()} == {
        (x, n.count(x), sum(y > x for y in n), sum(y for y in n if y > x), sum(min(x, y) for y in n), len(n)) for x in n}
    limits = [0, 1, 7, 100, 10**6]
    assert [tuple(r) for r in at_limits(sums, limits).collect()] == [(x, sum(y > x for y in n), sum(min(x, y) for y in n)) for x in limits]
    assert [r.n_tokens for r in at_quantiles(sums, [0.5, 1.0]).collect()] == [sorted(n)[-(-len(n) // 2) - 1], max(n)]
    assert with_suffix_sums(length_histogram(none, WORD)).count() == 0
