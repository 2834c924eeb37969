"""Shards of near equal size by best-fit-decreasing bin packing of indivisible groups.

A group is all rows of one text. Packing is hierarchical, so that no task and not the driver gets all groups:

* groups are dealt by hash into blocks of a bounded number of groups; each block packs its groups, largest first,
  into crates of a fixed small capacity (a fraction of a shard), every group into the crate with the tightest room
  that takes it; a larger group is a crate of its own;
* crates, of which there are a bounded number for each shard and at most one badly filled one for each block, are
  packed the same way into shards on the driver. Where the number of shards is given, the least capacity that needs no
  more shards is searched.

The tightest bin is found in a balanced tree of 64-way nodes over remaining capacities. Python is used as packing
goes item by item.

Null texts are one group, as are empty ones (of size 1 each, and crc 0). Equal rows are rows of one group. An empty table
gives no rows; other columns are ignored. A group larger than a shard's even share stays whole, so that shard is larger.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, small_side, stored


class CapacityTree:
    """Bins by remaining capacity; finds the least one of at least some size.

    Each node is a 64-bit mask of the children that hold bins, so all paths have equal length.
    """

    def __init__(self, capacity: int):
        self.levels = max(1, -(-max(capacity, 1).bit_length() // 6))
        self.masks: list[dict[int, int]] = [{} for _ in range(self.levels)]
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, number: int) -> None:
        self.bins.setdefault(room, []).append(number)
        for masks in self.masks:
            child, room = room & 63, room >> 6
            masks[room] = masks.get(room, 0) | 1 << child

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest bin with room for ``size``: its room and number."""
        key, level = size, 0
        while level < self.levels:
            mask = self.masks[level].get(key >> 6, 0) >> (key & 63)
            if mask:
                key += (mask & -mask).bit_length() - 1
                break
            key, level = (key >> 6) + 1, level + 1
        else:
            return None
        while level:
            level -= 1
            mask = self.masks[level][key]
            key = key << 6 | (mask & -mask).bit_length() - 1
        numbers = self.bins[key]
        number = numbers.pop()
        if not numbers:
            del self.bins[key]
            at = key
            for masks in self.masks:
                child, at = at & 63, at >> 6
                masks[at] &= ~(1 << child)
                if masks[at]:
                    break
                del masks[at]
        return key, number


def best_fit(sizes: Iterable[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each size (they must fall), and the number of bins; what is larger than a bin gets its own."""
    tree, bins, out = CapacityTree(capacity), 0, []
    for size in sizes:
        found = tree.take(size) if size <= capacity else None
        room, number = found or (max(capacity, size), bins)
        bins += found is None
        out.append(number)
        if room > size:
            tree.add(room - size, number)
    return out, bins


def fit_shards(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size (they must fall), by the least capacity for which best fit needs no more shards."""
    low, high = max([-(-sum(sizes) // shards), *sizes[:1]]), 2 * max([-(-sum(sizes) // shards), *sizes[:1]])
    best = best_fit(sizes, high)[0]
    while low < high:
        middle = (low + high) // 2
        bins, n = best_fit(sizes, middle)
        if n <= shards:
            best, high = bins, middle
        else:
            low = middle + 1
    return best


def crates_of(groups: DataFrame, capacity: int, blocks: int) -> DataFrame:
    """Each group (key, bytes) with its block and its crate there."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        g["crate"] = np.array(best_fit(g["bytes"].tolist(), capacity)[0], np.int32)
        return g[["key", "bytes", "block", "crate"]]

    dealt = groups.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(run, "key binary, bytes long, block int, crate int")


def shard_documents(
    docs: DataFrame, shards: int | None = 8, capacity: int | None = None, crates: int = 1024, block_groups: int = 100_000,
    slot_rows: int = 50_000,
) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot (gapless from 0 in a shard), grown_shard (null).

    With ``capacity`` instead of ``shards``, as few shards of that many bytes as best fit finds.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = stored(pick(docs, "doc_id", "text").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("key"),
    ), "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    totals = groups.agg(F.count("*"), F.sum("bytes"), F.sum("rows")).first()
    n_groups, total, n_rows = totals[0], totals[1] or 0, totals[2] or 0
    share = capacity or -(-total // shards)
    packed = stored(crates_of(groups, max(1, share // crates), -(-n_groups // block_groups) + 7), "shard-crates")
    # at most about two crates for each 1/1024 of a shard, and one for each block
    items = packed.groupBy("block", "crate").agg(F.sum("bytes").alias("bytes")).collect()
    items.sort(key=lambda r: (-r["bytes"], r["block"], r["crate"]))
    sizes = [r["bytes"] for r in items]
    shard = best_fit(sizes, capacity)[0] if capacity else fit_shards(sizes, shards)
    table = spark.createDataFrame(
        [(r["block"], r["crate"], s) for r, s in zip(items, shard)], "block int, crate int, shard int"
    )
    keys = packed.join(small_side(table, 12, len(items)), ["block", "crate"]).select("key", "shard")
    # rows are numbered in parts of a shard that are dealt by hash, and the parts one after another
    parts = -(-n_rows // slot_rows) + 15
    placed = rows.join(keys, "key").select(
        "doc_id", "size", "text_crc32", "shard",
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int").alias("part"),
    )
    placed = stored(placed, "shard-placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
