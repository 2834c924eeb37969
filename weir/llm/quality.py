"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each document gets four transformed statistics: log of the mean word length, of symbols per word, of the share of
repeated lines, and the share of words in repeated windows. Of each (language, source) the minimum covariance
determinant estimate is found by concentration steps from the coordinate medians: distances of all rows, the
``SHARE`` of rows nearest by them, mean and covariance of these, and again. Documents beyond a fixed Mahalanobis
distance are rejected. The covariance is regularised by a floor for each statistic, as most clean documents
have no symbols and no repeats at all. A group of fewer than ``LEAST_ROWS`` rows takes its language's estimate.
Statistics are kept as whole numbers of 1/2**12, so all sums are exact and don't depend on the order of rows.
Only SQL functions are used; medians and nearest shares come from histograms, so no group meets in one task.

Null and empty texts have no words and fail the base rules, as do texts of fewer than ten words; rows that fail them
take no part in the estimates. Null languages and sources are a group each. Repeated rows each count and each
get a result. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, pick, small_side, stored

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SCALE = 1 << 12
STATS = ("s0", "s1", "s2", "s3")
#: Least standard deviation of each statistic.
FLOORS = (0.35, 0.25, 0.5, 0.1)
SHARE = 0.75
#: Makes the covariance of the nearest 75 % of four normal statistics consistent.
CONSISTENT = 1.485
#: Squared distance of the 0.9999 quantile of chi-square with four degrees of freedom.
BEYOND = 23.51
LEAST_ROWS = 30
STEPS = 3
BUCKETS = 64


def repeated_words(words: Column, n: int = 5) -> Column:
    """Words within n-word windows that occur twice or more in the list; places that windows share count once."""
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)

    def covered(hashes: Column) -> Column:
        exact = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.array_join(F.slice(words, i + 1, n), " ").alias("w"), i.alias("i"))))

        def places(ordered: Column) -> Column:
            def same(i: Column) -> Column:
                return (F.get(ordered, i)["h"] == F.get(ordered, i + 1)["h"]) & (F.get(ordered, i)["w"] == F.get(ordered, i + 1)["w"])

            twice = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: F.coalesce(
                same(i), F.lit(False)) | F.when(i > 0, same(i - 1)).otherwise(False))
            return F.array_sort(F.transform(twice, lambda i: F.get(ordered, i)["i"]))

        def total(at: Column) -> Column:
            return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(
                at, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("end")),
                lambda acc, i: F.struct((acc["n"] + F.least(F.lit(n), i + n - acc["end"])).alias("n"), (i + n).alias("end")),
                lambda acc: acc["n"],
            ))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(exact, places), total))

    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(n)]))
    return F.when(F.size(words) < n, 0).otherwise(let(hashes, covered)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """The rows with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_lines, _n_repeat_words and _base_failed."""
    text = F.coalesce("_text", F.lit(""))
    rows = docs.withColumns({
        "_words": F.array_remove(F.split(text, SPACE + "+"), ""),
        "_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "_word_chars": (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
        "_n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
    })
    rows = rows.withColumns({
        "_n_words": F.size("_words").cast("long"), "_n_lines": F.size("_lines").cast("long"),
        "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_repeat_words": repeated_words(F.col("_words")),
    }).drop("_words", "_lines")
    failed = (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words"))
    n = F.greatest(F.col("_n_words"), F.lit(1))
    whole = lambda c: F.round(c * SCALE).cast("long")
    return rows.withColumns({
        "_base_failed": failed,
        "_s0": whole(F.log(F.greatest(F.col("_word_chars"), F.lit(1)) / n)),
        "_s1": whole(F.log1p(10 * F.col("_n_symbols") / n)),
        "_s2": whole(F.log1p(5 * F.col("_n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)))),
        "_s3": whole(F.col("_n_repeat_words") / n),
    })


def factor(center: list[Column], cov: dict[tuple[int, int], Column]) -> list[Column]:
    """Columns m0.. and the Cholesky factor l00, l10, l11, .. of a covariance matrix given by columns."""
    return [c.cast("double").alias(f"m{i}") for i, c in enumerate(center)] + [c.cast("double").alias(f"c{i}{j}") for (i, j), c in cov.items()]


def factored(estimates: DataFrame) -> DataFrame:
    """group, n, m0.. and l00, l10, .. from group, n, m0.. and c00, c10, .."""
    p, out = len(STATS), estimates
    for j in range(p):
        done = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - done, F.lit(1e-9))))
        out = out.withColumns({
            f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}")
            for i in range(j + 1, p)
        }) if j + 1 < p else out
    return out.drop(*[f"c{i}{j}" for i in range(p) for j in range(i + 1)])


def distance(stat: str = "s", estimate: str = "") -> Column:
    """Squared Mahalanobis distance of the statistics by m0.. and l00.. of the row."""
    z: list[Column] = []
    for i in range(len(STATS)):
        x = F.col(f"{stat}{i}") / SCALE - F.col(f"{estimate}m{i}")
        z.append((x - sum((F.col(f"{estimate}l{i}{k}") * z[k] for k in range(i)), F.lit(0.0))) / F.col(f"{estimate}l{i}{i}"))
    return sum((c * c for c in z), F.lit(0.0))


def share_bucket(rows: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """For each group the least ``bucket`` up to which at least a share of its rows lies."""
    counts = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("k"))
    upto = Window.partitionBy(*keys).orderBy("bucket")
    total = Window.partitionBy(*keys)
    counts = counts.select(*keys, "bucket", F.sum("k").over(upto).alias("upto"), F.sum("k").over(total).alias("n"))
    return counts.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * q), F.col("bucket"))).alias(name) for name, q in shares.items()
    ])


def start(rows: DataFrame) -> DataFrame:
    """Coordinate medians and quartile widths of each group as first estimates."""
    p = len(STATS)
    cells = rows.select("group", F.posexplode(F.array(*[F.floor(F.col(s) * BUCKETS / SCALE) for s in STATS])).alias("i", "bucket"))
    q = share_bucket(cells, ["group", "i"], {"low": 0.25, "middle": 0.5, "high": 0.75})
    wide = q.groupBy("group").agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(p) for c in ("low", "middle", "high")
    ])
    spread = lambda i: (F.col(f"high{i}") - F.col(f"low{i}") + 1) / BUCKETS / 1.349
    return wide.select(
        "group", "n", *[((F.col(f"middle{i}") + 0.5) / BUCKETS).alias(f"m{i}") for i in range(p)],
        *[(spread(i) * spread(i) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i + 1)],
    )


def concentrated(rows: DataFrame, estimates: DataFrame, groups: int) -> DataFrame:
    """One concentration step: estimates from the rows nearest by the last ones."""
    p = len(STATS)
    near = rows.join(small_side(factored(estimates).drop("n"), 200, groups), "group").select(
        "group", *STATS, F.floor(BUCKETS * F.log1p(distance("s"))).alias("bucket"))
    limits = share_bucket(near, ["group"], {"limit": SHARE}).select("group", "limit", F.col("n").alias("all"))
    nearest = near.join(small_side(limits, 40, groups), "group").where(F.col("bucket") <= F.col("limit"))
    sums = nearest.groupBy("group").agg(
        F.max("all").alias("n"), F.count("*").alias("k"), *[F.sum(s).alias(f"t{i}") for i, s in enumerate(STATS)],
        *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"t{i}{j}") for i in range(p) for j in range(i + 1)],
    )
    mean = [F.col(f"t{i}") / F.col("k") / SCALE for i in range(p)]
    cov = {
        (i, j): CONSISTENT * (F.col(f"t{i}{j}") / F.col("k") / SCALE ** 2 - mean[i] * mean[j]) + (FLOORS[i] ** 2 if i == j else 0.0)
        for i in range(p) for j in range(i + 1)
    }
    return sums.select("group", "n", *factor(mean, cov))


def judged(docs: DataFrame, name: str = "quality") -> DataFrame:
    """The rows without _text, _lang and _source, which they must have, written out with their measures; and _kept."""
    rows = stored(measured(docs).withColumns({
        "_own": F.to_json(F.struct("_lang", "_source"), {"ignoreNullFields": "false"}),
        "_wide": F.to_json(F.struct("_lang"), {"ignoreNullFields": "false"}),
    }).drop("_text", "_lang", "_source"), name)
    used = rows.where(~F.col("_base_failed")).select(
        F.explode(F.array("_own", "_wide")).alias("group"), *[F.col(f"_{s}").alias(s) for s in STATS])
    estimates = stored(start(used), f"{name}-start")
    groups = estimates.count()
    for step in range(STEPS):
        estimates = stored(concentrated(used, estimates, groups), f"{name}-step{step}")
    known = factored(estimates)
    values = [c for c in known.columns if c[0] in "ml"]
    one = F.struct(*values)
    own = known.where(F.col("n") >= LEAST_ROWS).select(F.col("group").alias("_own"), one.alias("_own_e"))
    wide = known.select(F.col("group").alias("_wide"), one.alias("_wide_e"))
    rows = rows.join(small_side(own, 200, groups), "_own", "left").join(small_side(wide, 200, groups), "_wide", "left")
    rows = rows.withColumn("_e", F.coalesce("_own_e", "_wide_e"))
    far = distance("_s", "_e.") > BEYOND
    return rows.withColumn("_kept", ~F.col("_base_failed") & ~F.coalesce(far, F.lit(False)))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rows = pick(docs, "doc_id", "text", "lang", "source").toDF("doc_id", "_text", "_lang", "_source")
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(rows).select("doc_id", *[F.col(f"_{m}").alias(m) for m in measures])


def good_documents(docs: DataFrame) -> DataFrame:
    """The kept rows of ``docs`` with all their columns."""
    held = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at = {n: F.col(f"_c{docs.columns.index(n)}") for n in ("text", "lang", "source")}
    rows = judged(held.withColumns({"_text": at["text"], "_lang": at["lang"], "_source": at["source"]}))
    return rows.where("_kept").select(*held.columns).toDF(*docs.columns)
