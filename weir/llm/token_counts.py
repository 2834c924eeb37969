"""Exact histogram of encoded lengths; suffix sums answer every context limit.

Documents are aggregated by encoded length, so that all later work is on one row per different length. Suffix sums run
within ranges of 256 lengths, plus the sums of the ranges above, so no task gets all lengths. Texts: null
and empty ones have length 0 (plus the end id, if one is asked for). Repeated rows each count. An empty table gives an
empty histogram. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .token_ids import encoded

RANGE = 256


def length_histogram(docs: DataFrame, path: str, end_id: int | None = None) -> DataFrame:
    """n_tokens, docs: how many documents have exactly so many tokens."""
    return encoded(docs, path, end_id).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: docs and tokens of that length, docs_longer and tokens_longer beyond it,
    docs_total, tokens_total, truncated_tokens (sum of min(length, L)), and quantile (share of documents up to L).

    The histogram is written out first, as it is read twice and texts should be encoded once.
    """
    histogram = stored(histogram, "token-histogram")
    rows = histogram.select(
        "n_tokens", "docs", (F.col("docs") * F.col("n_tokens")).alias("tokens"),
        F.floor(F.col("n_tokens") / RANGE).alias("range"),
    )
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranges = rows.groupBy("range").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t")).select(
        "range", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(everything).alias("docs_total"), F.sum("t").over(everything).alias("tokens_total"),
    )
    within = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = rows.join(ranges, "range").select(
        "n_tokens", "docs", "tokens", "docs_total", "tokens_total",
        (F.coalesce(F.sum("docs").over(within), F.lit(0)) + F.col("docs_above")).alias("docs_longer"),
        (F.coalesce(F.sum("tokens").over(within), F.lit(0)) + F.col("tokens_above")).alias("tokens_longer"),
    )
    return longer.select(
        "n_tokens", "docs", "tokens", "docs_longer", "tokens_longer", "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context, docs_cut, tokens_kept for each limit: documents longer than it, and tokens of texts cut to it.

    The sums of the longest length up to the limit tell; below every length, each document keeps the whole limit.
    """
    cells = F.struct("n_tokens", "tokens_total", "tokens_longer", "docs_longer")
    row = sums.agg(F.coalesce(F.max("docs_total"), F.lit(0)).alias("all"), *[
        F.max(F.when(F.col("n_tokens") <= n, cells)).alias(f"s{i}") for i, n in enumerate(limits)
    ])
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("context"), F.coalesce(f"s{i}.docs_longer", "all").alias("docs_cut"),
        F.coalesce(
            F.col(f"s{i}.tokens_total") - F.col(f"s{i}.tokens_longer") + F.col(f"s{i}.docs_longer") * n, F.col("all") * n
        ).alias("tokens_kept"),
    ) for i, n in enumerate(limits)])))


def at_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the least length that at least this share of the documents does not exceed."""
    return sums.agg(*[F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]).select(
        F.inline(F.array(*[F.struct(F.lit(q).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, q in enumerate(shares)]))
    )
