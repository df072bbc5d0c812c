"""Sharding by best-fit-decreasing bin packing.

Indivisible groups (equal texts) go, largest first, into the bin with the tightest remaining
capacity that still holds them, found in a balanced tree over the remaining capacities. For a
given capacity this minimises the number of shards; for a given number of shards the least capacity
that suffices is found by bisection.

At scale the packing sees sizes, not groups: best fit depends on nothing else, and of equal groups the tightest bin takes as
many as it holds before the next one is asked. So the driver gets one row per distinct size of a group (at most the square
root of twice the total size, far fewer in texts) and gives back how many groups of each size go to which shard; every group is placed as if packed
one by one. Groups of one size are told apart by their rank in the order of their hashes, which is counted in parts.

Nulls: a null text has size 8 (no bytes, plus 8) and the crc of nothing; all null texts are one group.
Empty texts are another. Repeated rows: equal texts, same shard, own slots. Ties: of bins with equal room the one opened first, of equal groups
the smaller hash. Very long texts count whole, and other columns are not looked at. An empty table gives
no rows. A group larger than the capacity raises the capacity to its size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows, or groups of one size, that are numbered in one window.
RUN = 10_000
#: Rows of the plan that are broadcast, at most.
BROADCAST = 2_000_000


class CapacityTree:
    """Bins by (capacity left, order of opening) in a treap: a search tree kept balanced by random ranks.

    ``take`` cuts it at the size asked for; the least bin of the upper part is the tightest that fits.
    """

    def __init__(self):
        self.left, self.right, self.key, self.rank, self.root = [], [], [], [], -1
        self._seed = 88172645463325252

    def _split(self, t: int, key) -> tuple[int, int]:
        if t < 0:
            return -1, -1
        if self.key[t] < key:
            self.right[t], b = self._split(self.right[t], key)
            return t, b
        a, self.left[t] = self._split(self.left[t], key)
        return a, t

    def _merge(self, a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        if self.rank[a] > self.rank[b]:
            self.right[a] = self._merge(self.right[a], b)
            return a
        self.left[b] = self._merge(a, self.left[b])
        return b

    def add(self, capacity: int, bin_: int) -> None:
        self._seed = (self._seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        self.left.append(-1), self.right.append(-1), self.key.append((capacity, bin_)), self.rank.append(self._seed)
        a, b = self._split(self.root, (capacity, bin_))
        self.root = self._merge(self._merge(a, len(self.key) - 1), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (capacity, bin) with the least capacity of at least ``size``; ties by bin."""
        a, b = self._split(self.root, (size, -1))
        if b < 0:
            self.root = a
            return None
        t = b
        while self.left[t] >= 0:
            t = self.left[t]
        key = self.key[t]
        _, rest = self._split(b, (key[0], key[1] + 1))
        self.root = self._merge(a, rest)
        return key


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, bin, how many) runs for (size, how many) groups in falling order of size; None if more than ``most`` bins are needed.

    The bin that takes one group is the tightest for the next of that size as well, while it holds one.
    """
    tree, bins, out = CapacityTree(), 0, []
    for size, count in sizes:
        while count:
            found = tree.take(size)
            if found is None:
                if size > capacity or (most is not None and bins == most):
                    return None
                found, bins = (capacity, bins), bins + 1
            taken = min(count, found[0] // size)
            out.append((size, found[1], taken))
            count -= taken
            tree.add(found[0] - taken * size, found[1])
    return out


def pack_evenly(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs in bins 0 to shards-1 by the least capacity (bisected) for which best fit needs no more."""
    total, largest = sum(s * n for s, n in sizes), max((s for s, _ in sizes), default=0)
    low = max(-(-total // shards), largest)
    best, high, step = best_fit_decreasing(sizes, low, shards), low, max(1, low // 1_000_000)
    while best is None:  # widen until it suffices
        low, high, step = high, high + step, 2 * step
        best = best_fit_decreasing(sizes, high, shards)
    while high - low > max(1, high // 100_000):
        middle = (low + high) // 2
        got = best_fit_decreasing(sizes, middle, shards)
        low, high, best = (low, middle, got) if got is not None else (middle, high, best)
    return best


def text_size(text: str):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def pack_shards(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = 24, capacity: int | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    ``shards``: sizes as near equal as whole groups allow. ``capacity`` instead: as few shards of
    at most so many bytes as best fit needs.
    """
    scratch = Scratch(spark, "shards")
    rows = df.select(
        F.col(id_col).alias("id"), text_size(text_col).alias("size"), F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("crc"),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.xxhash64(text_col)).alias("hash"), F.col(text_col).isNull().alias("none"))
    rows = scratch.write(rows, "rows")
    group = ["hash", "crc", "size", "none"]
    groups = scratch.write(rows.groupBy(*group).agg(F.sum("size").alias("bytes")), "groups")
    per_size = groups.groupBy("bytes").agg(F.count("*").alias("n"))
    sizes = [tuple(r) for r in sorted(per_size.collect(), reverse=True)]
    if capacity:
        runs = best_fit_decreasing(sizes, max(capacity, sizes[0][0] if sizes else 0))
    else:
        runs = pack_evenly(sizes, shards)
    plan = pd.DataFrame(runs, columns=["bytes", "shard", "taken"], dtype="int64")
    plan["first"] = plan.groupby("bytes")["taken"].cumsum() - plan["taken"]
    plan = spark.createDataFrame(plan[["bytes", "shard", "first", "taken"]], "bytes long, shard int, first long, taken long")

    # the rank of each group among those of its size, in parts of about RUN groups by the hash
    part = F.pmod(F.shiftright("hash", 7), F.ceil(F.col("n") / F.lit(RUN)).cast("long"))
    ranked = groups.join(per_size, "bytes").withColumn("part", part)
    ranked = _numbered(ranked, ["bytes", "part"], "bytes", "part", ["hash", "crc", "none"], "rank")
    ranked = ranked.join(F.broadcast(plan) if len(runs) <= BROADCAST else plan, "bytes").where("rank >= first AND rank < first + taken")
    placed = scratch.write(ranked.select(*group, "shard"), "placed")

    # slots: rows of a shard, in parts of about RUN rows by the id
    keyed = scratch.write(rows.join(placed, group).select("id", "size", "crc", "shard"), "keyed")
    held = keyed.groupBy("shard").agg(F.count("*").alias("n"))
    keyed = keyed.join(F.broadcast(held) if len(runs) <= BROADCAST else held, "shard").withColumn("part", F.pmod(F.xxhash64("id", "crc"), F.ceil(F.col("n") / F.lit(RUN)).cast("long")))
    return _numbered(keyed, ["shard", "part"], "shard", "part", ["id", "size", "crc"], "slot").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _numbered(df: DataFrame, keys: list[str], whole: str, part: str, order: list[str], name: str) -> DataFrame:
    """``df`` with gapless numbers from 0 within ``whole``: a window inside each part, after the counts of the parts before it."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(whole).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, before.alias("before"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", place).join(counts, keys).withColumn(name, F.col("before") + F.col("place") - 1).drop("before", "place")
