"""Reproducible random columns (R-1 … R-5).

Each adds the column ``sample``. A draw depends on the seed and the row's id only, never on the
partition, so a retried task draws the same numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import array_literal, hashed_uniform, with_count_le

DEFAULT_SEED = 12345  # Fixed value: the default seed of the reference's samplers.


def with_gaussian(
    df: DataFrame, id: str = "id", mean: float = 0.0, std: float = 1.0, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Normal draws (Box–Muller transform of two uniforms)."""
    radius = F.sqrt(-2 * F.log(1 - hashed_uniform(seed, 1, id)))
    angle = 2 * math.pi * hashed_uniform(seed, 2, id)
    return df.withColumn("sample", mean + std * radius * F.cos(angle))


def with_exponential(
    df: DataFrame, id: str = "id", rate: float = 1.0, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Exponential draws of the given rate. (The reference reads the rate but ignores it.)"""
    if rate <= 0:
        raise ValueError("the rate must be positive")
    return df.withColumn("sample", -F.log(1 - hashed_uniform(seed, 1, id)) / rate)


def _by_table(df: DataFrame, weights: list[float], id: str, seed: int) -> DataFrame:
    """Index drawn in proportion to ``weights``, by binary search in the cumulative table."""
    total, cumulative, sum_so_far = math.fsum(weights), [], 0.0
    for w in weights[:-1]:
        sum_so_far += w / total
        cumulative.append(sum_so_far)
    table = array_literal(cumulative, "array<double>")
    u = hashed_uniform(seed, 1, id)
    drawn = with_count_le(df, "sample", table, len(cumulative), u)
    return drawn.withColumn("sample", F.col("sample").cast("double"))


def with_categorical(
    df: DataFrame, weights: list[float], id: str = "id", seed: int = DEFAULT_SEED
) -> DataFrame:
    """Index 0 … len(weights)-1 drawn by weight; the weights need not add up to 1."""
    if any(w < 0 for w in weights) or sum(weights) == 0:
        raise ValueError("weights must not be negative and must not all be zero")
    return _by_table(df, list(weights), id, seed)


def with_poisson(
    df: DataFrame, id: str = "id", rate: float = 1.0, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Poisson draws, from a table of the probabilities up to a tail below 1e-12."""
    if rate <= 0:
        raise ValueError("the rate must be positive")
    weights, k, covered = [], 0, 0.0
    while covered < 1 - 1e-12 or k <= rate:
        weights.append(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)))
        covered += weights[-1]
        k += 1
        if k > rate + 40 * math.sqrt(rate) + 40:
            break
    return _by_table(df, weights, id, seed)


def with_zipf(
    df: DataFrame, id: str = "id", s: float = 2.0, v: float = 5.0, n: int = 99,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Zipf–Mandelbrot draws over 0 … n with probability proportional to (v + k)^-s."""
    if s <= 1 or v < 1 or n < 0:
        raise ValueError("needs s > 1, v >= 1 and n >= 0")
    weights = [(v + k) ** -s for k in range(n + 1)]
    return _by_table(df, weights, id, seed)
