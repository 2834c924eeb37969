"""Positional joins, set membership, cache lookups and rules in force."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.duration import window_micros
from ..plans.lookups import lookup_join
from ..plans.ordering import spread
from ..plans.streams import Stream, arrival, of_stream, require_id


def zip_join(
    a: DataFrame, b: DataFrame, ts: str = "ts", id: str = "id", clears: DataFrame | None = None,
    clear_ts: str = "ts", rows_per_chunk: int | None = None,
) -> DataFrame:
    """Pair the i-th message of ``a`` with the i-th of ``b``: ``epoch``, ``idx``, ``A``, ``B``.

    Every clear drops what waits on either side, so the pairing starts again in the next epoch.
    Both sides order by ``(ts, id)``; a clear at a message's time comes before it.
    """
    require_id(a, id), require_id(b, id)
    if clears is None:
        clears = a.limit(0).select(F.lit(None).cast("timestamp").alias(clear_ts))
    side_a, side_b = F.col("_rank") == 1, F.col("_rank") == 2
    scan = arrival(
        Stream(clears, clear_ts), Stream(a, ts, id), Stream(b, ts, id),
        rows_per_chunk=rows_per_chunk,
    ).scan(
        epoch=("sum", (F.col("_rank") == 0).cast("int")),
        _a=("sum", side_a.cast("int")), _b=("sum", side_b.cast("int")),
    )
    done = F.when(F.col("_rank") == 0, F.struct("_a", "_b"))
    scan = scan.scan(_done=("last", done))
    seen = lambda side: F.col(side) - F.coalesce(F.col("_done")[side], F.lit(0)) - 1
    # Partners meet in a group of two. (A self-join would run the scan once per side.)
    sides = scan.df.where(side_a | side_b).select(
        "epoch", F.when(side_a, seen("_a")).otherwise(seen("_b")).alias("idx"), "_m1", "_m2"
    )
    # Shuffled before they are grouped: halves that are a chunk apart or more don't shrink in the chunk's own task.
    pairs = spread(sides, ["epoch", "idx"], scan.width).groupBy("epoch", "idx").agg(
        F.first("_m1", ignorenulls=True).alias("A"), F.first("_m2", ignorenulls=True).alias("B")
    )
    return pairs.where(F.col("A").isNotNull() & F.col("B").isNotNull())


def is_member(
    probes: DataFrame, adds: DataFrame, key: str, ts: str = "ts", add_key: str | None = None,
    add_ts: str | None = None,
) -> DataFrame:
    """``probes`` with ``isMember``: whether the key was added at or before the probe.

    Adds shrink to one row per key before the join, with partial aggregation, and a key that is
    probed very often is split on the probe side.
    """
    first = (
        adds.groupBy(F.col(add_key or key).alias("_key")).agg(F.min(add_ts or ts).alias("_first"))
    )
    joined = lookup_join(probes, first, [key], ["_key"])
    member = F.coalesce(F.col("_first") <= F.col(ts), F.lit(False))
    return joined.select(*[F.col(c) for c in probes.columns], member.alias("isMember"))


def keep_members(
    df: DataFrame, adds: DataFrame, key: str, ts: str | None = None, add_key: str | None = None,
    add_ts: str | None = None,
) -> DataFrame:
    """The messages whose key is in the set (J3): as of the message's time when ``ts`` is given,
    else in the set as a whole. ``add_ts`` is the time column of the adds, if it has another name."""
    if ts is not None:
        return is_member(df, adds, key, ts, add_key, add_ts).where("isMember").drop("isMember")
    return lookup_join(df, _keys(adds, add_key or key), [key], ["_key"], "left_semi")


def drop_members(
    df: DataFrame, adds: DataFrame, key: str, ts: str | None = None, add_key: str | None = None,
    add_ts: str | None = None,
) -> DataFrame:
    """The messages whose key is not in the set; see ``keep_members``."""
    if ts is not None:
        return is_member(df, adds, key, ts, add_key, add_ts).where("not isMember").drop("isMember")
    return lookup_join(df, _keys(adds, add_key or key), [key], ["_key"], "left_anti")


def _keys(adds: DataFrame, key: str) -> DataFrame:
    return adds.select(F.col(key).alias("_key")).distinct()


def cache_lookup(
    lookups: DataFrame, puts: DataFrame, key: str, value: str, ttl: str, ts: str = "ts",
    id: str = "id", put_key: str | None = None, rows_per_chunk: int | None = None,
) -> DataFrame:
    """``lookups`` with ``value``, the latest value put under the key.

    The put must be at most ``ttl`` old, else the value is null. A lookup does not extend an
    entry's life; a newer put restarts it. Puts at a lookup's time are seen. Rows without a key
    are left out.
    """
    put_at = F.struct(F.col("_us").alias("at"), F.col(f"_m0.{value}").alias("value"))
    scan = arrival(
        Stream(puts, ts, require_id(puts, id), put_key or key), Stream(lookups, ts, None, key),
        rows_per_chunk=rows_per_chunk,
    ).scan(_put=("last", F.when(F.col("_rank") == 0, put_at))).df
    live = F.col("_us") - F.col("_put.at") <= window_micros(ttl)
    return of_stream(scan, 1, F.when(live, F.col("_put.value")).alias("value"))


def cache_lookup_keys(
    puts: DataFrame, keys: DataFrame, key: str, value: str, as_of: str | Column, ttl: str,
    ts: str = "ts", id: str = "id",
) -> DataFrame:
    """Look up a list of keys at one instant: ``key``, ``value``, null for a miss."""
    from .aggregate import cache_snapshot

    live = cache_snapshot(puts, key, value, as_of, ttl, ts, id)
    return keys.select(F.col(key).alias("key")).distinct().join(live, "key", "left")


def merge(*dfs: DataFrame) -> DataFrame:
    """All messages of several streams (J6); columns that one lacks are null there."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), dfs)


def with_rules(
    df: DataFrame, rules: DataFrame, ts: str = "ts", id: str = "id", rule_ts: str = "ts",
    rule_id: str = "id", rows_per_chunk: int | None = None,
) -> DataFrame:
    """``df`` with the parameter columns of the rule in force (J8): the last one that arrived at
    or before the message; null before the first rule."""
    params = [c for c in rules.columns if c not in (rule_ts, rule_id)]
    scan = arrival(
        Stream(rules, rule_ts, require_id(rules, rule_id)), Stream(df, ts, require_id(df, id)),
        rows_per_chunk=rows_per_chunk,
    ).scan(_rule=("last", F.col("_m0"))).df
    return of_stream(scan, 1, *[F.col(f"_rule.{p}").alias(p) for p in params])


__all__ = [
    "cache_lookup", "cache_lookup_keys", "drop_members", "is_member", "keep_members", "merge",
    "with_rules", "zip_join",
]
