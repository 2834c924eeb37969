"""Many-to-one joins in which one key may hold a large share of the many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(
    many: DataFrame, one: DataFrame, many_keys: list[str], one_keys: list[str], how: str = "left"
) -> DataFrame:
    """Join ``many`` with ``one``, which has at most one row per key and no column of ``many``.

    ``one`` is mostly an aggregate. Joined as it stands, it would keep the aggregate's partitioning,
    and adaptive execution splits a hot key only where both join inputs come straight from a shuffle.
    So the key is wrapped, which gives ``one`` a shuffle of its own: one row per key moves, and then
    a hot key of ``many`` is split over as many tasks as its size asks for. Where ``one`` is small,
    adaptive execution broadcasts it instead.
    """
    pack = lambda cols: F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(cols)])
    left = many.withColumn("_join", F.when(_all_set(many_keys), pack(many_keys)))
    right = one.withColumn("_join_one", F.when(_all_set(one_keys), pack(one_keys)))
    joined = left.join(right, F.col("_join") == F.col("_join_one"), how)
    return joined.drop("_join", "_join_one")


def _all_set(cols: list[str]):
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out
