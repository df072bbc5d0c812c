"""Mixing sources to target weights by capped water-filling.

Every source has a weight. Its share of the total is in proportion to its weight, but no source is
repeated more than ``epochs`` times: sources above that are clamped and the excess is shared
again among the others by weight, until none is above. A source's whole repetitions take
every document; the fractional one takes documents in a seeded order up to the target, the last
of them in part.

The order is cut into buckets of about RUN documents of the whole table, so that no more than that is sorted anywhere: a bucket before the
target is taken whole, one after it not at all, and only the one in which the target falls is sorted.

Nulls: a null text has size 0; null sources are one source, which comes last. Documents of size 0 take
0. A source of size 0 has target 0. An empty table gives no rows. Repeated rows are taken like any
other; equal rows may swap places in the order without effect, and ties in the order go by id and size. Very long texts are counted whole.
Only the id, the text and the source are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Documents in one bucket of the seeded order, about, and buckets at least.
RUN, BUCKETS = 50_000, 1024
#: Sources whose plan is broadcast, at most.
PLAN = 100_000


def water_fill(sizes: list[float], weights: list[float], total: float, epochs: float) -> list[float]:
    """Targets by weight that sum to ``total`` where the caps epochs * size allow it."""
    target, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0], float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > epochs * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def words_in(text: str):
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _order(key: Column, text: Column, seed: int) -> Column:
    """The place of a row in the seeded order: rows without id, or with equal ids, have places by their texts."""
    return F.xxhash64(key, text, F.lit(seed))


def mix_sources(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple = (5, 2, 1), epochs: int = 3, seed: int = 17, orders: bool = False) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row, with ``orders`` also its place in the order; ``weights`` repeat over the sources in order.

    The driver gathers one row per source, and broadcasts that plan only up to PLAN sources.
    """
    scratch = Scratch(spark, "mixture")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(text_col).alias("size"), _order(F.col(id_col), F.col(text_col), seed).alias("order"))
    rows = scratch.write(rows, "rows")
    bits = max(BUCKETS, rows.count() // RUN).bit_length() - 1
    rows = rows.withColumn("bucket", F.shiftrightunsigned("order", 64 - bits))
    sums = scratch.write(rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")), "sums")
    sources = sorted(sums.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in sources]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], sum(sizes), epochs)
    plan = []
    for r, target in zip(sources, targets):
        whole = int(min(epochs, target // r["size"])) if r["size"] else 0
        plan.append((r["source"], r["size"], float(target), whole, round(target) - whole * r["size"]))
    held = len(plan)
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, whole int, part long")
    plan = F.broadcast(plan) if held <= PLAN else plan

    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.col("size").alias("held"), F.coalesce(F.sum("size").over(by_bucket), F.lit(0)).alias("before"))
    sums = sums.join(plan, sums["source"].eqNullSafe(plan["source"])).select(
        sums["source"], "bucket", "source_size", "target", "whole",
        F.greatest(F.lit(0), F.least("held", F.col("part") - F.col("before"))).alias("room"), "held")
    if len(sources) << bits <= 250_000:
        sums = F.broadcast(sums)
    both = rows.alias("r").join(sums.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket")))
    both = both.select("r.id", "r.source", "r.size", "order", "r.bucket", "source_size", "target", "whole", "room", "held")
    cut = (F.col("room") > 0) & (F.col("room") < F.col("held"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    some = both.where(cut).withColumn("ahead", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    some = some.withColumn("more", F.greatest(F.lit(0), F.least("size", F.col("room") - F.col("ahead")))).drop("ahead")
    rest = both.where(~cut).withColumn("more", F.when(F.col("room") > 0, F.col("size")).otherwise(F.lit(0)))
    return rest.unionByName(some).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"), *["order"] * orders)


def repeated(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple = (5, 2, 1), epochs: int = 3, seed: int = 17) -> DataFrame:
    """``df`` with every row as often as the mix takes it; a row taken in part counts as taken from half of it on.

    A source's rows are taken some whole number of times, and once more up to a place in its seeded order. So a row per source tells all,
    and the texts themselves are neither joined by id nor shuffled. Rows without words are not taken; rows with equal ids and texts are taken alike.
    """
    place = _order(F.col(id_col), F.col(text_col), seed).bitwiseXOR(F.lit(-(1 << 63)))  # signed comparison in unsigned order
    plan = mix_sources(spark, df, id_col, text_col, source_col, weights, epochs, seed, orders=True).where("size > 0")
    plan = plan.select(F.col(source_col).alias("__source"), F.col("order").bitwiseXOR(F.lit(-(1 << 63))).alias("place"), F.floor(F.col("taken") / F.col("size") + 0.5).alias("times"), F.floor(F.col("target") / F.col("source_size")).alias("whole"))
    plan = Scratch(spark, "repeated").write(plan.groupBy("__source").agg(F.first("whole").alias("__whole"), F.max(F.when(F.col("times") > F.col("whole"), F.col("place"))).alias("__last")), "plan")
    held = plan.count()
    met = df.join(F.broadcast(plan) if held <= PLAN else plan, F.col(source_col).eqNullSafe(F.col("__source")))
    times = F.col("__whole") + F.when(place <= F.col("__last"), 1).otherwise(0)
    times = F.when(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), times).otherwise(0)
    return met.withColumn("__times", times.cast("int")).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*df.columns)
