"""Line dedup by a segment-partition edit join.

Two lines are linked if they are equal, or if both have LEAST characters or more and one edit (EDITS), or as many as
their length allows up to ``edits``, turn one into the other. For one edit: by the partition principle, of EDITS + 1 = 2 segments of a line one is free of edits; the other is split again
in the same way, once more, so linked lines agree in all but one of four leaves. A line is indexed under each of
its four (length, leaf, text around the leaf), and probes the same places of lines one character shorter. Keys that
only one line has are dropped. The leaves of those that remain are halved further, with the shared keys kept
each time, down to one character: lines that still share a key are linked, so a key needs no pairs but those with one
line of it. Links are then verified by banded bit-parallel edit distance on the leaves they first differed in.

With ``edits`` over 1, lines of FAR characters or more are linked by one edit for each PER_EDIT characters of the shorter,
``edits`` at most: two for 40 characters, four from 80 on. Lines fall into classes of length. All lines of a class have one segment
more than edits, of the same size: the first half counted from the line's start, the others from its end, so that places don't
depend on the length within the class. A line is indexed under each of its segments, and looks up the substrings next to them in its
class, and in the class below if a line as many characters shorter as it may be lies there. Of linked lines, one segment j (from 0)
of the shorter is free of edits with j edits to its left and at most allowed - j to its right (edits to the left less j start at 0,
end below 0 and only sink by 1, over a free segment), so shifts go up to j from the start and up to allowed - j from the end: 13 keys
for four edits, whatever the lengths. All keys are dealt out once, with the line's hash, and those of different lines kept where they
arrive; of a line with very many copies only those in one document make keys. The lines of a key are first compared with one of them;
keys whose lines are then not all connected are compared in blocks. Pairs are compared by lengths and counts of common letters, which
rule out most, then Spark's banded edit distance. Key tables hold hashes only; texts are read for lines of shared keys.

Of each class of linked lines the first line (least doc_id, then place) stays, the others are removed from their
texts. Only SQL functions are used. A hot line or key is summed before it is shuffled, and otherwise only joined.

Null and empty texts have no lines; lines without a word are never removed. Rows of one doc_id are one document: each
keeps its first lines. Rows without doc_id keep a line unless a document with one has it. Equal rows get equal results;
an empty table gives none; other columns are ignored, or returned as they are by ``without_repeats``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lookups import lookup_join
from .common import let, pick, small_side, stored
from .graph import components

EDITS = 1
#: Of the registered query and the pipeline.
MOST_EDITS = 4
PER_EDIT = 20
FAR = 2 * PER_EDIT
LEAST = 16
#: Lines, and characters, of a block.
BLOCK_LINES = 64
BLOCK_CHARS = 1 << 16
#: Copies of a line from which it is hot, and the most hot lines; of larger tables, as many copies as leave no more.
COPIES = 100
HOT_LINES = 20_000
#: One byte each in UTF-8; other letters are not counted.
LETTERS = "etaoinsrhldcumfp"
LEAVES = 4
WORD = r"[^\x20\x09-\x0D]"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, place, line, h of each line with a word."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("place", "line"))
    return rows.where(F.col("line").rlike(WORD)).withColumn("h", F.xxhash64("line"))


def line_list(docs: DataFrame) -> DataFrame:
    """doc_id, place, h of each line with a word; short: its text, if it has LEAST to FAR characters."""
    short = F.when(F.char_length("line").between(LEAST, FAR), F.col("line"))
    return lines_of(docs).select("doc_id", "place", "h", short.alias("short"))


def leaf_keys(line: Column) -> Column:
    """Array of key, role (0 indexed, 1 probing for lines one shorter), start and length of the leaf."""
    def keys(n: Column) -> Column:
        def one(x: Column) -> Column:
            role, i = F.floor(x / LEAVES).cast("int"), x % LEAVES
            size = n - role
            start, end = F.floor(i * size / LEAVES).cast("int"), F.floor((i + 1) * size / LEAVES).cast("int")
            after = size - end
            return F.struct(
                F.xxhash64(size, i, F.substr(line, F.lit(1), start), F.substr(line, n - after + 1, after)).alias("key"),
                role.alias("role"), (start + 1).alias("start"), (n - after - start).alias("length"),
            )

        return F.transform(F.sequence(F.lit(0), F.lit(2 * LEAVES - 1)), one)

    return let(F.char_length(line), keys)


def shared(rows: DataFrame) -> DataFrame:
    """key, of those that different lines (h) have."""
    return rows.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("key")


def halves(leaf: Column, role: Column) -> Column:
    """The two ways on: which half still differs, the text of the other, and the half."""
    n = F.char_length(leaf)
    cut = F.floor((n - role) / 2).cast("int")
    left, right = cut + role, n - cut
    return F.array(
        F.struct(F.lit(0).alias("side"), F.substr(leaf, left + 1, n - left).alias("rest"), F.substr(leaf, F.lit(1), left).alias("leaf")),
        F.struct(F.lit(1).alias("side"), F.substr(leaf, F.lit(1), cut).alias("rest"), F.substr(leaf, cut + 1, right).alias("leaf")),
    )


def halved(rows: DataFrame) -> DataFrame:
    small = F.char_length("leaf") - F.col("role") <= 1
    stay = F.array(F.struct(F.lit(2).alias("side"), F.lit("").alias("rest"), F.col("leaf").alias("leaf")))
    ways = rows.select("key", "first", "h", "role", F.inline(F.when(small, stay).otherwise(halves(F.col("leaf"), F.col("role")))))
    return ways.select(F.when(F.col("side") == 2, F.col("key")).otherwise(F.xxhash64("key", "side", "rest")).alias("key"), "first", "h", "role", "leaf")


def within_one(a: Column, b: Column) -> Column:
    """Whether the edit distance of two texts is EDITS at most: for each character of b, a bit set of the diagonals
    of the band for each number of edits."""
    width = 2 * EDITS + 1
    full = (1 << width) - 1

    def run(both: Column) -> Column:
        x, y = both["x"], both["y"]

        def deeper(same: list[Column]) -> list[Column]:
            """Deletions: from one diagonal to the next, with one edit more."""
            out = [same[0]]
            for e in range(1, EDITS + 1):
                out.append(same[e].bitwiseOR(F.shiftleft(out[e - 1], 1)).bitwiseAND(full))
            return out

        def step(acc: Column, j: Column) -> Column:
            hits = reduce(lambda m, n: m.bitwiseOR(n), [
                F.when(F.get(x, j + d - 1) == F.get(y, j - 1), 1 << (d + EDITS)).otherwise(0) for d in range(-EDITS, EDITS + 1)
            ])

            def moved(match: Column) -> Column:
                same = [acc[f"e{e}"].bitwiseAND(match) for e in range(EDITS + 1)]
                same = [same[0]] + [
                    same[e].bitwiseOR(acc[f"e{e - 1}"]).bitwiseOR(F.shiftright(acc[f"e{e - 1}"], 1)) for e in range(1, EDITS + 1)
                ]
                return F.struct(*[c.cast("int").alias(f"e{e}") for e, c in enumerate(deeper(same))])

            return let(hits.cast("int"), moved)

        first = deeper([F.lit(1 << EDITS)] + [F.lit(1 << EDITS)] * EDITS)
        begin = F.struct(*[c.cast("int").alias(f"e{e}") for e, c in enumerate(first)])
        end = F.aggregate(F.sequence(F.lit(1), F.size(y)), begin, step, lambda acc: acc[f"e{EDITS}"])
        reached = F.when(F.size(y) == 0, F.size(x) <= EDITS).otherwise(
            F.getbit(end, F.size(x) - F.size(y) + EDITS) == 1)
        return F.when(F.abs(F.size(x) - F.size(y)) > EDITS, False).otherwise(reached)

    def letters(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))

    return let(F.struct(letters(a).alias("x"), letters(b).alias("y")), run)


def length_class(n: Column, edits: int) -> Column:
    """Least length of the class of lines of ``n`` characters (FAR or more): multiples of PER_EDIT as long as another edit is allowed
    for them, then steps of a sixteenth of the power of two below, 16 at least."""
    most = edits * PER_EDIT
    step = F.greatest(F.lit(16), F.call_function("shiftleft", F.lit(1), F.length(F.bin(n)) - 5))
    return F.when(n < most, n - n % PER_EDIT).otherwise(F.greatest(F.lit(most), n - n % step)).cast("int")


def probes(allowed: int) -> list[int]:
    """Segment and shift, in one number, of all keys of a line."""
    reach = [min(j, allowed - j) for j in range(allowed + 1)]
    return [j * 64 + shift + 32 for j in range(allowed + 1) for shift in range(-reach[j], reach[j] + 1)]


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """key, h, indexed (or else probing) and the edits allowed, for segments of lines (h, line) of FAR characters or more."""
    n, low, allowed = F.col("n"), F.col("low"), F.col("allowed")
    own, below = length_class(n, edits), length_class(F.greatest(F.lit(FAR), n - edits), edits)
    classes = F.when(own == below, F.array(own)).otherwise(F.array(own, below))
    wide = lines.select("h", F.encode("line", "UTF-32").alias("wide"))  # four bytes a character: places need no walk through the text
    rows = wide.withColumn("n", F.shiftright(F.octet_length("wide"), 2)).select("h", "wide", "n", F.posexplode(classes).alias("other", "low"))
    rows = rows.withColumn("allowed", F.least(F.lit(edits), F.floor(low / PER_EDIT)).cast("int"))
    table = F.array(*[F.array(*[F.lit(x) for x in (probes(e) if e * PER_EDIT >= FAR else [])]).cast("array<int>") for e in range(1, edits + 1)])
    rows = rows.select("h", "wide", "n", "other", "low", "allowed", F.explode(F.element_at(table, allowed)).alias("x"))
    j, shift, size = F.shiftright("x", 6), F.col("x").bitwiseAND(63) - 32, F.floor(low / (allowed + 1)).cast("int")
    start = F.when(j * 2 <= allowed, j * size).otherwise(n - (allowed - j + 1) * size) + shift
    return rows.select(
        F.xxhash64(low, j, F.substr("wide", start * 4 + 1, size * 4)).alias("key"), "h",
        ((shift == 0) & (F.col("other") == 0)).alias("indexed"), "allowed")


def word_marks(line: Column) -> Column:
    """64 parities of the line's words, by hash. An edit changes a word, cuts one in two or joins two: at most three parities."""
    def turn(acc: Column, word: Column) -> Column:
        return acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(word).bitwiseAND(63).cast("int")))

    return F.aggregate(F.split(line, " ", -1), F.lit(0).cast("long"), turn)


def letter_counts(line: Column) -> Column:
    """How often each of LETTERS is in the line."""
    return F.array(*[F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS])


def letters_apart(x: Column, y: Column) -> Column:
    """Of two lines' counts: letters that one line has more than the other, the larger of both ways. An edit adds and takes away one at most."""
    def more(a: Column, b: Column) -> Column:
        return reduce(lambda m, n: m + n, [F.greatest(F.get(a, i) - F.get(b, i), F.lit(0)) for i in range(len(LETTERS))])

    return F.greatest(more(x, y), more(y, x))


def thinned(lines: DataFrame, listed: DataFrame) -> DataFrame:
    """h, line of the lines, of a hot one only those in its first document, if that has a doc_id."""
    copies = stored(listed.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > COPIES), "line-copies")
    limit = max(COPIES, listed.count() // HOT_LINES)
    hot = listed.join(F.broadcast(copies.where(F.col("n") > limit).select("h")), "h").groupBy("h").agg(F.min("doc_id").alias("hot_doc"))
    rows = lines.join(F.broadcast(hot.withColumnRenamed("h", "hot")), F.col("h") == F.col("hot"), "left")
    return rows.where("hot_doc is null or doc_id = hot_doc").select("h", "line")


def far_links(docs: DataFrame, listed: DataFrame, edits: int) -> DataFrame:
    """a, b: hashes of lines of FAR characters or more (the longer of a link may have more), enough links to connect all that links connect."""
    lines = lines_of(docs).where(F.char_length("line") >= FAR)
    key = Window.partitionBy("key")
    every = segment_keys(thinned(lines, listed), edits).select(
        "*", F.min("h").over(key).alias("least"), F.max("h").over(key).alias("most"), F.max("indexed").over(key).alias("any"))
    members = stored(every.where(F.col("any") & (F.col("least") < F.col("most"))).groupBy("key", "h", "allowed").agg(
        F.max("indexed").alias("indexed")), "line-members")
    wanted = members.select("h").distinct()
    texts = stored(lines.select("h", "line").join(small_side(wanted, 16), "h").groupBy("h").agg(F.any_value("line").alias("line")).select(
        "h", "line", F.char_length("line").alias("n"), letter_counts(F.col("line")).alias("counts")), "line-texts")
    looks = texts.select("h", F.struct("n", "counts").alias("look"))

    def alike(x: Column, y: Column, allowed: Column) -> Column:
        return (F.abs(x["n"] - y["n"]) <= allowed) & (letters_apart(x["counts"], y["counts"]) <= allowed)

    def close(x: Column, y: Column, allowed: Column) -> Column:
        far = edits + 1  # the distance is -1 where it exceeds edits; worked out once for each pair
        return F.pmod(F.levenshtein(x, y, edits), F.lit(far + 1)) <= allowed

    pivots = members.where("indexed").groupBy("key").agg(F.min("h").alias("a"))
    tried = lookup_join(members, pivots.toDF("pivot_key", "a"), ["key"], ["pivot_key"], "inner").where("a <> h").groupBy(
        "a", F.col("h").alias("b")).agg(F.max("allowed").alias("allowed"))
    tried = lookup_join(tried, looks.toDF("a_h", "look_a"), ["a"], ["a_h"], "inner")
    tried = lookup_join(tried, looks.toDF("b_h", "look_b"), ["b"], ["b_h"], "inner")
    tried = tried.where(alike(F.col("look_a"), F.col("look_b"), F.col("allowed"))).select("a", "b", "allowed")
    tried = lookup_join(tried, texts.select(F.col("h").alias("a_h"), F.col("line").alias("line_a")), ["a"], ["a_h"], "inner")
    tried = lookup_join(tried, texts.select(F.col("h").alias("b_h"), F.col("line").alias("line_b")), ["b"], ["b_h"], "inner")
    direct = stored(tried.where(close(F.col("line_a"), F.col("line_b"), F.col("allowed"))).select("a", "b"), "line-direct")
    joined = components(direct).toDF("h", "component")
    known = stored(members.join(small_side(joined, 24), "h", "left").withColumn("component", F.coalesce("component", "h")), "line-known")
    parted = known.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where(
        "least < most and n > 2")  # of two lines, one is the key's pivot
    open_keys = lookup_join(known, parted.select(F.col("key").alias("open"), "n"), ["key"], ["open"], "inner")
    whole = texts.select(F.col("h").alias("h_open"), F.struct("line", "n", "counts").alias("text"))
    spread = stored(lookup_join(open_keys, whole, ["h"], ["h_open"], "inner").select("key", "h", "component", "indexed", "allowed", "text", "n"), "line-open")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_LINES), F.floor(BLOCK_CHARS / F.col("size"))))
    counts = spread.groupBy("key").agg(F.first("n").alias("n"), F.max("text.n").alias("size")).select(
        F.col("key").alias("many"), F.ceil(F.col("n") / room).alias("blocks"))
    blocks = stored(lookup_join(spread, counts, ["key"], ["many"], "inner").groupBy(
        "key", "allowed", "blocks", F.pmod(F.xxhash64("h", "key"), "blocks").alias("block")).agg(
        F.collect_list(F.struct("h", "component", "indexed", "text")).alias("some")), "line-blocks")
    alone, many = blocks.where("blocks = 1").drop("blocks"), blocks.where("blocks > 1").drop("blocks")
    both = many.join(many.select("key", F.col("block").alias("block_b"), F.col("some").alias("others")), "key").where("block <= block_b").unionByName(
        alone.withColumns({"block_b": F.col("block"), "others": F.col("some")}))

    def paired(x: Column) -> Column:
        def fits(y: Column) -> Column:
            new = (x["component"] != y["component"]) & (x["indexed"] | y["indexed"]) & ((F.col("block") < F.col("block_b")) | (x["h"] < y["h"]))
            able = F.when(new, alike(x["text"], y["text"], F.col("allowed"))).otherwise(False)
            return F.when(able, close(x["text"]["line"], y["text"]["line"], F.col("allowed"))).otherwise(False)

        return F.transform(F.filter("others", fits), lambda y: F.struct(x["h"].alias("a"), y["h"].alias("b")))

    found = joined.where("h <> component").select(F.col("h").alias("a"), F.col("component").alias("b"))  # connects what direct does
    return found.union(both.select(F.inline(F.flatten(F.transform("some", paired)))).distinct())


def line_links(docs: DataFrame, listed: DataFrame, edits: int = EDITS) -> DataFrame:
    """a, b: hashes of lines, enough links to connect all lines that links connect; ``listed``: their ``line_list``."""
    if edits <= EDITS:
        return near_links(lines_of(docs).where(F.char_length("line") >= LEAST).select("h", "line"))
    return near_links(listed.where("short is not null").select("h", F.col("short").alias("line"))).union(far_links(docs, listed, edits))


def near_links(long_lines: DataFrame) -> DataFrame:
    """Of lines (h, line) one edit apart."""
    every = long_lines.select("h", F.explode(F.transform(leaf_keys(F.col("line")), lambda k: k["key"])).alias("key"))
    keys = stored(shared(every), "line-keys")
    found = long_lines.select("h", "line", F.inline(leaf_keys(F.col("line")))).join(small_side(keys, 16), "key").select(
        "key", "h", "role", F.expr("substr(line, start, length)").alias("leaf")).distinct()
    leaves = stored(found, "line-leaves")
    rows = leaves.select("key", F.col("key").alias("first"), "h", "role", "leaf")
    while rows.where(F.char_length("leaf") - F.col("role") > 1).limit(1).count():
        finer = stored(halved(halved(rows)), "line-halves")
        rows = stored(finer.join(shared(finer), "key"), "line-shared").select("key", "first", "h", "role", "leaf")
    # indexed lines of a key differ in one character; a probing line may drop either of its two
    pivots = rows.where("role = 0").groupBy("key", "first").agg(F.min("h").alias("a"))
    replaced = rows.where("role = 0").join(pivots, ["key", "first"]).select("first", "a", F.col("h").alias("b"))
    letters = F.when(F.char_length("leaf") == 2, F.array(F.substring("leaf", 1, 1), F.substring("leaf", 2, 1))).otherwise(F.array(F.lit("")))
    probing = rows.where("role = 1").select("key", "first", F.col("h").alias("b"), F.explode(letters).alias("leaf"))
    indexed = rows.where("role = 0").select("key", "first", F.col("h").alias("a"), "leaf")
    dropped = indexed.join(probing, ["key", "first", "leaf"]).select("first", "a", "b")
    pairs = replaced.union(dropped).where("a <> b").distinct()
    texts = leaves.select(F.col("key").alias("first"), "h", "leaf")
    return pairs.join(texts.toDF("first", "a", "leaf_a"), ["first", "a"]).join(texts.toDF("first", "b", "leaf_b"), ["first", "b"]).where(
        within_one(F.col("leaf_a"), F.col("leaf_b"))).select("a", "b").distinct()


def repeats(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, places (array of the lines to remove) of the documents that have some."""
    listed = stored(line_list(docs), "line-list")
    links = stored(components(line_links(docs, listed, edits)), "line-classes")
    classes = stored(listed.join(small_side(links.toDF("h", "component"), 24), "h", "left").select(
        "doc_id", "place", F.coalesce("component", "h").alias("class")), "line-class-list")
    first = classes.groupBy("class").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")
    again = stored(lookup_join(classes, first.select(F.col("class").alias("of"), "first_doc"), ["class"], ["of"], "inner").select(
        "class", "doc_id", "place", F.col("doc_id").eqNullSafe(F.col("first_doc")).alias("mine")), "line-again")
    stays = again.where("mine").groupBy("class").agg(F.min("place").alias("stays"))
    gone = lookup_join(again, stays.withColumnRenamed("class", "of"), ["class"], ["of"], "inner").where("not mine or place <> stays")
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("place")).alias("places"))


def cleaned(docs: DataFrame, doc_id: Column, text: Column, edits: int = EDITS) -> DataFrame:
    """The rows with _places (to remove, or null) and _clean, the text without them."""
    gone = stored(repeats(docs.select(doc_id.alias("doc_id"), text.alias("text")), edits), "line-repeats").toDF("_id", "_places")
    size = gone.agg(F.count("*"), F.sum(F.size("_places"))).first()
    rows = docs.join(small_side(gone, 40 + 4 * (size[1] or 0) // max(1, size[0]), size[0]), doc_id.eqNullSafe(F.col("_id")), "left")

    def joined(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_places")
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    kept = let(F.split(text, "\n", -1), joined)
    return rows.withColumn("_clean", F.when(F.col("_places").isNull(), text).otherwise(kept)).drop("_id")


def line_dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, removed (places from 0, comma-joined), clean_sha256 (of what is left)."""
    rows = cleaned(pick(docs, "doc_id", "text"), F.col("doc_id"), F.col("text"), edits)
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(WORD)))
    places = F.coalesce("_places", F.array().cast("array<int>"))
    return rows.select(
        "doc_id", n.cast("long").alias("n_lines"), F.size(places).cast("long").alias("n_removed"),
        F.array_join(places.cast("array<string>"), ",").alias("removed"), F.sha2(F.coalesce("_clean", F.lit("")), 256).alias("clean_sha256"),
    )


def without_repeats(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The rows of ``docs``, all their columns, their texts without repeated lines; rows of which no word is left go.

    Rows that had no word at first stay.
    """
    held = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index("text")
    doc_id, text = F.col(f"_c{docs.columns.index('doc_id')}"), F.col(f"_c{at}")
    rows = cleaned(held, doc_id, text, edits).where(F.col("_places").isNull() | F.col("_clean").rlike(WORD))
    return rows.withColumn(f"_c{at}", F.col("_clean")).select(*held.columns).toDF(*docs.columns)
