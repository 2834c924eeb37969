"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the 64-bit hashes of its different 5-word shingles. Set sizes fall into bands whose ends grow by
1/0.8; similar sets lie in one band or in two adjacent ones, and pairs go by the band of the smaller set, so each set signs
for its own band and the one before. Similar sets of m and n shingles differ in k = (m + n)/9 at most. For small k, the domain of hashes is cut into k + 2 parts and all
pairs of parts sign: at most k parts differ, so one pair agrees. For larger k it is cut into k + 1 + e parts (e is
0.3 k) and each part signs for itself, but a set leaves out the e parts that are last by (elements, hash of content). Of
the e + 1 or more parts that agree, the first in that order is left out by neither set, so no similar pair is lost, while
parts of no or one element mostly are.

Equal sets are one member. Members that share a signature are first tried against one pivot of it (the least
member): each member verifies against the pivot it shares most signatures with, then against the others it isn't
yet connected to. Where members of a signature are still in different components, the pairs across components are tried
as well: a lower bound of the difference by parities of small parts comes first, so few are read, and each member tries
its nearest before all that is then still open. Every pair that shares a signature is in the end verified, excluded by a
bound, or connected already: components are exact.

Components and joins are DataFrame operations; sets, signatures and parities are numpy work in tasks.
Words: A-Z in lower case, runs without ASCII white space. Null, empty and blank texts have no shingles and are linked
with nothing; fewer than five words are one shingle. Equal rows are copies of one another. Rows without doc_id
belong to a component like others, but don't name it, unless nothing else does. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, short_batches, small_side, stored
from .graph import components

N = 5
#: Sizes of at most so many differing elements are signed by pairs of parts.
FEW = 3
SPARE = 0.3
SEEN = 100_000
LONG_WORD = 64
SET = pa.list_(pa.int64())
#: Odd factors of the words of a shingle.
PLACES = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, N + 1, dtype=np.uint64)
#: Members of one signature that are compared in one group.
BLOCK = 2_000
#: 64-bit words that are held for one group; parts of larger groups are folded.
CELLS = 4_000_000
#: Of so many members one is signed beforehand, and a signature of more than about so many members is shuffled in parts.
SAMPLE = 16
PART_ROWS = 1_000


class Hashes(dict):
    """64-bit hashes of words; the words seen before are looked up, as long as they are few and short."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= SEEN:
                self.clear()
            self[word] = h
        return h


def shingles(text: bytes | None, hashes: Hashes) -> np.ndarray:
    """Sorted different 5-word hashes of a text; one hash for fewer words, none for no word."""
    # both methods of bytes know ASCII only: A-Z, and white space
    words = (text or b"").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) == 0:
        return h
    size = min(len(h), N)
    grams = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        grams += h[i:len(h) - size + 1 + i] * PLACES[i]
    return np.unique(mix(grams))


def member_of(grams: np.ndarray) -> int | None:
    """Hash of a set, signed; None for an empty one."""
    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None


def mapped(rows: DataFrame, kept: str, made: dict[str, pa.DataType], of: Callable[[np.ndarray], tuple]) -> DataFrame:
    """Columns ``kept`` of rows (longs, comma-separated), and those that ``of`` makes of the shingles of the text."""
    names = kept.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            values = zip(*(of(shingles(t.as_py(), hashes)) for t in b["text"])) if len(b) else [[] for _ in made]
            columns = [pa.array(v, kind) for v, kind in zip(values, made.values())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), *columns], names=[*names, *made])

    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in names]
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", SET: "array<bigint>"}
    schema = ", ".join([*fields, *(f"{c} {kinds[kind]}" for c, kind in made.items())])
    return rows.select(*names, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size) and member (hash of the sorted set, null for an empty one)."""
    return mapped(docs, "doc_id", {"n": pa.int32(), "member": pa.int64()}, lambda s: (len(s), member_of(s)))


def with_set(rows: DataFrame, kept: str, name: str) -> DataFrame:
    """Columns ``kept`` of rows and the set of the text."""
    return mapped(rows, kept, {name: SET}, lambda s: (s.view(np.int64),))


@cache
def bands_of(size: int) -> list[tuple[int, int]]:
    """Band and most differing elements of the pairs that a set of this size can be in: as smaller set, as larger set.

    Pairs go by the band of their smaller set. Of sizes m <= n <= 5 m / 4, at most (m + n) / 9 elements differ.
    """
    band, low, before = 0, 1, 0
    while low * 5 // 4 < size:
        before = low * 5 // 4
        band, low = band + 1, before + 1
    ends = [(band, low * 5 // 4)] + ([(band - 1, before)] if before * 5 // 4 >= size else [])
    return [(b, (end + end * 5 // 4) // 9) for b, end in ends]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_sums(hashes: np.ndarray, part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements of each part and the sum of their scrambled hashes, exact as two halves."""
    m = mix(hashes)
    low = np.bincount(part, (m & np.uint64(0xFFFFFFFF)).astype(np.float64), parts).astype(np.uint64)
    high = np.bincount(part, (m >> np.uint64(32)).astype(np.float64), parts).astype(np.uint64)
    return np.bincount(part, minlength=parts), low + (high << np.uint64(32))


def signatures(hashes: np.ndarray, band: int, k: int) -> np.ndarray:
    """Signatures of one set for pairs of a band, of which at most ``k`` elements differ."""
    if k == 0:
        return np.zeros(0, np.uint64)
    h = hashes.astype(np.uint64)
    mark = np.uint64(band << 32)
    if k <= FEW:
        n, s = part_sums(h, (mix(h ^ np.uint64(7)) % np.uint64(k + 2)).astype(np.int64), k + 2)
        pairs = np.array(list(combinations(range(k + 2), 2)))
        first, second = pairs.T
        return mix(mix(s[first] + mark) * np.uint64(3) + mix(s[second] ^ mark) + np.arange(len(pairs), dtype=np.uint64))
    spare = int(SPARE * k)
    n, s = part_sums(h, (mix(h ^ np.uint64(7)) % np.uint64(k + 1 + spare)).astype(np.int64), k + 1 + spare)
    key = mix(s + mark + np.arange(len(s), dtype=np.uint64))
    return key[np.lexsort((key, -n))[: k + 1]]


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each of four to eight times as many parts as elements (a power of two): whether it holds an odd number.

    Where two sets differ in a bit, at least one element of that part is in one of them only.
    """
    parts = 64 << max(0, int(np.ceil(np.log2(max(len(hashes), 1) / 16))))
    part = (mix(hashes.astype(np.uint64) ^ np.uint64(11)) & np.uint64(parts - 1)).astype(np.int64)
    return np.packbits((np.bincount(part, minlength=parts) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities (64-bit words) of fewer parts: a weaker bound, but still one."""
    return np.bitwise_xor.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), member (hash of the set, null for an empty one), sigs: its signatures, or null where the set is
    empty or its task has signed an equal one before. One pass over the texts serves for all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hashes = Hashes()
        for b in batches:
            n, member, sigs = [], [], []
            for t in b["text"]:
                s = shingles(t.as_py(), hashes)
                m = member_of(s)
                n.append(len(s))
                member.append(m)
                if m is None or m in seen:
                    sigs.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(m)
                sigs.append(np.concatenate([signatures(s, band, k) for band, k in bands_of(len(s))]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n, pa.int32()), pa.array(member, pa.int64()), pa.array(sigs, SET)],
                names=["doc_id", "n", "member", "sigs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n int, member long, sigs array<bigint>")


def signed(rows: DataFrame) -> DataFrame:
    """sig, member of all sets of described rows; copies in one task sign once."""
    return rows.select(F.explode("sigs").alias("sig"), "member")


def linked(docs: DataFrame, owners: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b: members) whose sets are similar enough. Each set of b travels to its a once."""
    n = pairs.count()
    who = owners.select("doc_id", "member")
    left = pairs.join(who.withColumnRenamed("member", "b"), "b").select("doc_id", "a", "b")
    right = pairs.select("a").distinct().join(who.withColumnRenamed("member", "a"), "a").select("doc_id", "a")
    b_sets = with_set(docs.join(small_side(left, 24, n), "doc_id"), "a, b", "set_b")
    a_sets = with_set(docs.join(small_side(right, 16, n), "doc_id"), "a", "set_a")
    both = b_sets.join(a_sets.hint("merge"), "a").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("i"),
                                                         (F.size("set_a") + F.size("set_b")).alias("t"))
    return both.where(180 * F.col("i") >= 80 * F.col("t")).select("a", "b")


def still_open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, one, other (blocks), member, component: what is left to compare.

    Pairs with the pivot are done, so pivots are left out. Of signatures with the same members one is kept. More than
    BLOCK members come in blocks, each pair of blocks once, so a group that is compared stays small.
    """
    rows = stored(shared.join(labels, "member").select("sig", "member", "component"), "near-open")
    marks = F.xxhash64("member"), F.xxhash64("member", F.lit(1))
    groups = rows.groupBy("sig").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"),
        *[F.bit_xor(m).alias(f"x{i}") for i, m in enumerate(marks)],
    ).where("low < high")
    kept = groups.groupBy("n", "x0", "x1").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    dealt = rows.join(kept, "sig").withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")))
    dealt = dealt.select("sig", "block", "member", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"))
    return dealt.select("sig", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), "block", "member", "component")


def nearest_of(pairs: np.ndarray) -> np.ndarray:
    """Of pairs (rows i, j, distance) those that are the nearest of i or of j."""
    order = pairs[np.argsort(pairs[:, 2], kind="stable")]
    ends = np.stack([order[:, 0], order[:, 1]], axis=1).ravel()
    return order[np.unique(np.unique(ends, return_index=True)[1] // 2)]


def allowed_pairs(n: np.ndarray, component: np.ndarray, block: np.ndarray, mixed: bool, bits: list[np.ndarray], nearest: bool) -> np.ndarray:
    """Rows i, j, lower bound of the difference: the sets (by rising n) of different components that sizes and each of
    the parities allow; all of them or the nearest of each set."""
    found, step = [np.zeros((0, 3), np.int64)], max(1, CELLS // 4 // len(n))
    for low in range(0, len(n), step):
        first = slice(low, low + step)
        ok = (component[first, None] != component) & (4 * n <= 5 * n[first, None])
        if mixed:
            ok &= block[first, None] != block
        i, j = np.nonzero(np.triu(ok, low + 1))
        i += low
        d = np.zeros(len(i), np.int64)
        for x in bits:
            some = max(1, CELLS // 8 // x.shape[1])
            d = np.concatenate([d[:0], *(
                np.bitwise_count(x[i[k:k + some]] ^ x[j[k:k + some]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), some))])
            fit = 9 * d <= n[i] + n[j]
            i, j, d = i[fit], j[fit], d[fit]
        pairs = np.stack([i, j, d], axis=1)
        found.append(nearest_of(pairs) if nearest else pairs)
    pairs = np.concatenate(found)
    return nearest_of(pairs) if nearest else pairs


def across(rows: DataFrame, nearest: bool) -> DataFrame:
    """a, b (a below b): pairs in one signature, of different components, that sizes and parities allow."""
    def run(g: pa.Table) -> pa.Table:
        n, member, component, block = (g[c].to_numpy() for c in ("n", "member", "component", "block"))
        order = np.lexsort((member, n))
        n, member, component, block = (x[order].astype(np.int64) for x in (n, member, component, block))
        raw = g["bits"].to_pylist()
        bits = [np.frombuffer(raw[i], np.uint64) for i in order]
        words = min(map(len, bits))
        while words > 1 and words * len(n) > CELLS:
            words //= 2
        fine = np.stack([folded(x, words) for x in bits])
        mixed = g["one"][0].as_py() != g["other"][0].as_py()
        i, j, _ = allowed_pairs(n, component, block, mixed, [folded(fine, max(1, words // 8)), fine], nearest).T
        return pa.table({"a": np.minimum(member[i], member[j]), "b": np.maximum(member[i], member[j])})

    return rows.groupBy("sig", "one", "other").applyInArrow(run, "a long, b long").distinct()


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """member, component of all members."""
    found = components(links)
    return members.join(found.withColumnRenamed("node", "member"), "member", "left").select(
        "member", F.coalesce("component", "member").alias("component"))


def known_links(labels: DataFrame) -> DataFrame:
    """Links a, b of labelled members that connect what the labels tell."""
    return labels.where("member <> component").select(F.col("member").alias("a"), F.col("component").alias("b"))


def crowded(docs: DataFrame, owners: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """sig, parts: signatures that many members have, as those members tell whose hash is a multiple of SAMPLE.

    It only decides how rows are shuffled, never which. ``rows`` are all documents as described, if they are stored.
    """
    some = F.pmod("member", F.lit(SAMPLE)) == 0
    if rows is None:
        rows = described(docs.join(small_side(owners.where(some).select("doc_id"), 16), "doc_id", "left_semi"))
    n = signed(rows.where(some)).distinct().groupBy("sig").agg((F.count("*") * SAMPLE).alias("n"))
    return stored(n.where(F.col("n") > PART_ROWS).select("sig", F.ceil(F.col("n") / PART_ROWS).alias("parts")), "near-crowded")


def after_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sig, part, member: repeats go, low is the first member of sig and part, and that member's
    own row goes where there is no part."""
    last = None
    for b in batches:
        sig, member = b["sig"].to_numpy(), b["member"].to_numpy()
        part = b["part"].fill_null(-1).to_numpy(zero_copy_only=False)
        if not len(sig):
            continue
        was = [np.concatenate([x[:1] if last is None else [v], x[:-1]]) for x, v in zip((sig, part, member), last or (0, 0, 0))]
        start = (sig != was[0]) | (part != was[1])
        start[0] |= last is None
        place = np.maximum.accumulate(np.where(start, np.arange(len(sig)), -1))
        low = np.where(place < 0, last[3] if last else 0, member[place])
        kept = start & (part >= 0) | ~start & (member != was[2])
        last = sig[-1], part[-1], member[-1], low[-1]
        columns = {"sig": sig[kept], "member": member[kept], "part": part[kept], "low": low[kept]}
        yield pa.record_batch({name: pa.array(x, pa.int64()) for name, x in columns.items()})


def shared_signatures(docs: DataFrame, owners: DataFrame, described_rows: DataFrame) -> DataFrame:
    """sig, member, pivot (least member of the signature, another than this one).

    One shuffle by signature serves to drop repeats, find pivots and drop signatures of one member; a crowded signature
    is dealt to several tasks by member, and what each found least is put together.
    """
    split = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("member"), "parts"))
    rows = signed(described_rows).join(small_side(crowded(docs, owners, described_rows), 16), "sig", "left").select("sig", "member", split.alias("part"))
    dealt = rows.repartition("sig", "part").sortWithinPartitions("sig", "part", "member")
    found = stored(dealt.mapInArrow(after_first, "sig long, member long, part long, low long"), "near-found")
    whole = stored(found.where("part >= 0").groupBy("sig").agg(F.min("low").alias("least")), "near-ends")
    rows = found.join(small_side(whole, 16), "sig", "left").withColumn("pivot", F.coalesce("least", "low"))
    return rows.where("pivot <> member").select("sig", "member", "pivot")


def near_links(docs: DataFrame, owners: DataFrame, described_rows: DataFrame) -> DataFrame:
    """Links a, b between members, enough of them to connect all that are connected."""
    shared = shared_signatures(docs, owners, described_rows)
    stars = shared.groupBy("pivot", "member").agg(F.count("*").alias("k"))
    ranked = stored(stars.select(
        F.col("pivot").alias("a"), F.col("member").alias("b"),
        F.row_number().over(Window.partitionBy("member").orderBy(F.desc("k"), "pivot")).alias("place")), "near-stars")
    members = ranked.select(F.explode(F.array("a", "b")).alias("member")).distinct()
    links = stored(linked(docs, owners, ranked.where("place = 1")), "near-links")
    labels = stored(labelled(members, links), "near-labels")

    def apart(pairs: DataFrame) -> DataFrame:
        ends = pairs.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b")
        return ends.where("ca <> cb").select("a", "b")

    more = stored(bounded(docs, owners, apart(ranked.where("place > 1"))), "near-more")
    links = known_links(labels).union(stored(linked(docs, owners, more), "near-links"))
    labels = stored(labelled(members, links), "near-labels")
    rows = stored(still_open(shared, labels), "near-compared")
    known = with_parities(docs, owners, rows.select("member").distinct())
    tried = ranked.select("a", "b")
    for nearest in (True, False):
        fresh = stored(across(rows.join(known, "member"), nearest).join(tried, ["a", "b"], "left_anti"), "near-fresh")
        links = known_links(labels).union(stored(linked(docs, owners, fresh), "near-links"))
        if nearest:
            labels = stored(labelled(members, links), "near-labels")
            rows = stored(still_open(rows.select("sig", "member").distinct(), labels), "near-compared")
            tried = tried.union(fresh)
    return links


def with_parities(docs: DataFrame, owners: DataFrame, members: DataFrame) -> DataFrame:
    """member, n, bits of the given members."""
    wanted = stored(owners.join(members, "member").select("doc_id", "member"), "near-wanted")
    rows = docs.join(small_side(wanted, 16), "doc_id")
    return stored(mapped(rows, "member", {"n": pa.int32(), "bits": pa.binary()}, lambda s: (len(s), parities(s))), "near-bits")


def bounded(docs: DataFrame, owners: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that sizes and parities allow."""
    @F.pandas_udf("boolean")
    def allowed(na: pd.Series, nb: pd.Series, xa: pd.Series, xb: pd.Series) -> pd.Series:
        out = []
        for n, m, x, y in zip(na, nb, xa, xb):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            words = min(len(x), len(y))
            out.append(9 * int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64)) <= n + m)
        return pd.Series(out, dtype=bool)

    pairs = stored(pairs, "near-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("member")).distinct()
    known = with_parities(docs, owners, ends)
    both = pairs.join(known.toDF("a", "na", "xa"), "a").join(known.toDF("b", "nb", "xb"), "b")
    return both.where(allowed("na", "nb", "xa", "xb")).select("a", "b")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    short_batches(docs.sparkSession)
    texts = pick(docs, "doc_id", "text")
    rows = stored(described(texts), "near-members")
    owners = stored(rows.where("member is not null and doc_id is not null").groupBy("member").agg(F.min("doc_id").alias("doc_id")), "near-owners")
    found = stored(components(near_links(texts, owners, rows)), "near-components")
    named = found.toDF("member", "component").join(owners, "member").groupBy("component").agg(F.min("doc_id").alias("least"))
    linked_members = found.toDF("member", "component").join(named, "component").select("member", "least")
    classes = owners.join(linked_members, "member", "left").select("member", F.least("doc_id", "least").alias("component_id"))
    whole = rows.join(classes, "member", "left")
    return whole.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, with only the first document (least doc_id) of each component."""
    gone = stored(near_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-gone")
    held = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    return held.join(small_side(gone, 8), F.col(f"_c{docs.columns.index('doc_id')}") == F.col("_gone"), "left_anti").toDF(*docs.columns)
