"""Glyph vectors: soft distance, averages, nearest prototype, seeding and upkeep of clusters.

Glyphs are arrays; a glyph meets prototypes in packs of PACK, one row per pack, so distances need neither an explode nor a shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphtally import settings as S
from glyphtally.functions.numeric import margin
from glyphtally.operators.lineage import cut, numbered

#: Prototypes in one row.
PACK = 64
#: Prototypes that are broadcast, at most; more are dealt out to the glyphs by pack.
BROADCAST = 10_000


def glyphs(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple = ()) -> DataFrame:
    """(id, *keep, glyph): the ink of each cell, negative components being no ink."""
    ink = F.transform(vector_col, lambda e: F.greatest(e.cast("double"), F.lit(0.0)))
    return df.where(F.col(vector_col).isNotNull()).select(id_col, *keep, ink.alias("glyph"))


def soft_distance(a: Column, b: Column) -> Column:
    """Sum of differences over sum of maxima, 1 for two blanks."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    gap, most = total(F.zip_with(a, b, lambda x, y: F.abs(x - y))), total(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return F.when(most > 0, gap / F.greatest(most, F.lit(1e-300))).otherwise(F.lit(S.BLANK_DISTANCE))


def averages(members: DataFrame, by: str) -> DataFrame:
    """(by, glyph): the average glyph of each group."""
    cells = members.select(by, F.posexplode("glyph").alias("pos", "c")).groupBy(by, "pos").agg(F.avg("c").alias("p"))
    return cells.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("glyph"))


def _packed(prototypes: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(pack, protos): the prototypes in rows of about PACK, broadcast up to BROADCAST of them; and how many packs."""
    held = cut(prototypes)
    n = held.count()
    packs = max(1, -(-n // PACK))
    rows = held.withColumn("pack", F.pmod(F.xxhash64(key), F.lit(packs))).groupBy("pack").agg(F.collect_list(F.struct(*prototypes.columns)).alias("protos"))
    return (F.broadcast(rows) if n <= BROADCAST else rows), packs


def _met(df: DataFrame, prototypes: DataFrame, key: str) -> tuple[DataFrame, int]:
    rows, packs = _packed(prototypes, key)
    return df.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long")))).join(rows, "pack"), packs


def _compared(df: DataFrame, prototypes: DataFrame, id_col: str, proto_col: str, digits: int | None) -> tuple[DataFrame, int]:
    """(id, d): distances and prototypes of each glyph and pack."""
    met, packs = _met(df.select(id_col, "glyph"), prototypes.select(proto_col, "glyph"), proto_col)

    def one(t):
        d = soft_distance(F.col("glyph"), t["glyph"])
        return F.struct((F.round(d, digits) if digits is not None else d).alias("distance"), t[proto_col].alias(proto_col))

    return met.select(id_col, F.transform("protos", one).alias("d")), packs


def distances(df: DataFrame, prototypes: DataFrame, id_col: str, proto_col: str, digits: int | None = None) -> DataFrame:
    """(id, proto, distance) of all glyphs (id, glyph) and prototypes (proto, glyph)."""
    d, _ = _compared(df, prototypes, id_col, proto_col, digits)
    return d.select(id_col, F.explode("d").alias("d")).select(id_col, f"d.{proto_col}", "d.distance")


def _two(df: DataFrame, id_col: str, what: str, d: Column) -> DataFrame:
    best, second = F.get(d, F.lit(0)), F.get(d, F.lit(1))
    out = df.select(id_col, best[what].alias(what), best["distance"].alias("best"), second["distance"].alias("second"))
    return out.withColumn("margin", margin(F.col("best"), F.col("second")))


def nearest(df: DataFrame, prototypes: DataFrame, id_col: str, proto_col: str, digits: int | None = None) -> DataFrame:
    """(id, proto, best, second, margin): first prototype of the least distance, and the runner-up's distance. Distances may be rounded first."""
    d, packs = _compared(df, prototypes, id_col, proto_col, digits)
    if packs > 1:
        d = d.select(id_col, F.slice(F.array_sort("d"), 1, 2).alias("d")).groupBy(id_col).agg(F.flatten(F.collect_list("d")).alias("d"))
    return _two(d, id_col, proto_col, F.array_sort("d"))


def nearest_two(dist: DataFrame, id_col: str, proto_col: str) -> DataFrame:
    """As `nearest`, of a table (id, proto, distance)."""
    ranked = dist.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("distance", proto_col))).alias("d"))
    return _two(ranked, id_col, proto_col, F.col("d"))


def spread(members: DataFrame, prototypes: DataFrame, group_col: str) -> DataFrame:
    """(group, members, spread, sharpness): mean distance of members (group, glyph) to their prototype (group, glyph)."""
    met = members.select(group_col, "glyph").join(prototypes.select(group_col, F.col("glyph").alias("p")), group_col)
    out = met.groupBy(group_col).agg(F.count("*").alias("members"), F.avg(soft_distance(F.col("glyph"), F.col("p"))).alias("spread"))
    return out.withColumn("sharpness", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - S.SHARPNESS_SLOPE * F.col("spread"))))


def merge_close(prototypes: DataFrame, proto_col: str, limit: float = S.MERGE_DISTANCE) -> DataFrame:
    """(proto, kept_as): in order, each open prototype takes the later open ones closer than the limit."""
    near = distances(prototypes.withColumnRenamed(proto_col, "a"), prototypes, "a", proto_col).where((F.col("a") < F.col(proto_col)) & (F.col("distance") < limit))
    return settle(prototypes.select(F.col(proto_col).alias("id")), near.select("a", F.col(proto_col).alias("b"))).select(F.col("id").alias(proto_col), "kept_as")


def settle(items: DataFrame, beats: DataFrame) -> DataFrame:
    """Greedy survival. ``beats`` (a, b): a comes before b and is too close to it.

    An item is kept if no kept item beats it; else it belongs to the first that does (``kept_as``). A round keeps the open items that nothing open
    beats, drops what they beat, and goes on with the edges between items still open, so rounds shrink fast.
    """
    beats = cut(beats.select("a", "b").distinct())
    open_, beaten = beats, []
    while open_.limit(1).count():
        below = open_.select(F.col("b").alias("a"), F.lit(True).alias("below")).distinct()
        marked = open_.join(below, "a", "left").withColumn("top", F.col("below").isNull())
        lost = marked.groupBy("b").agg(F.max("top").alias("b_lost"))
        marked = marked.join(lost, "b").join(lost.toDF("a", "a_lost"), "a", "left")
        marked = cut(marked.select("a", "b", "b_lost", F.coalesce("a_lost", F.lit(False)).alias("a_lost")))
        beaten.append(marked.where("b_lost").select(F.col("b").alias("id")))
        open_ = marked.where("NOT a_lost AND NOT b_lost").select("a", "b")
    if not beaten:
        return items.select("id", F.col("id").alias("kept_as"))
    gone = cut(reduce(DataFrame.union, beaten).distinct())
    first = beats.join(gone.toDF("a"), "a", "left_anti").groupBy("b").agg(F.min("a").alias("by"))
    return items.select("id").join(first.withColumnRenamed("b", "id"), "id", "left").select("id", F.coalesce("by", "id").alias("kept_as"))


def leaders(df: DataFrame, id_col: str, limit: float = S.JOIN_DISTANCE, batch: int = 512) -> DataFrame:
    """(id, leader): in order of id, a glyph joins the nearest leader before it that is closer than the limit, else it leads.

    The first ``batch`` open glyphs, and never more, are folded in one task; what their leaders take is no longer open. So comparisons grow with the
    glyphs times the leaders, and rounds with the leaders over the batch.
    """
    items = cut(df.select(F.col(id_col).alias("id"), "glyph"))
    open_, found = items, []

    def lead(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept = pdf.sort_values("id").reset_index(drop=True), []
        x = np.stack(pdf["glyph"].to_numpy())
        for k in range(len(x)):
            most = np.maximum(x[kept], x[k]).sum(1)
            near = np.where(most > 0, np.abs(x[kept] - x[k]).sum(1) / np.maximum(most, 1e-300), S.BLANK_DISTANCE)
            if not (near < limit).any():
                kept.append(k)
        return pdf.loc[kept]

    while open_.limit(1).count():
        first = cut(open_.orderBy("id").limit(batch))
        heads = cut(first.groupBy().applyInPandas(lead, first.schema))
        found.append(heads)
        near = nearest(open_.join(first.select("id"), "id", "left_anti"), heads.withColumnRenamed("id", "head"), "id", "head")
        open_ = cut(open_.join(near.where(F.col("best") >= limit).select("id"), "id"))
    if not found:
        return items.select(F.col("id").alias(id_col), F.col("id").alias("leader"))
    led = cut(reduce(DataFrame.union, found)).withColumnRenamed("id", "leader")
    near = distances(items, led, "id", "leader").where((F.col("leader") < F.col("id")) & (F.col("distance") < limit))
    best = near.groupBy("id").agg(F.min(F.struct("distance", "leader"))["leader"].alias("by"))
    own = items.select("id").join(led.select(F.col("leader").alias("id"), F.lit(True).alias("leads")), "id", "left").join(best, "id", "left")
    return own.select(F.col("id").alias(id_col), F.when(F.col("leads"), F.col("id")).otherwise(F.col("by")).alias("leader"))


def refine(df: DataFrame, members: DataFrame, id_col: str, group_col: str, passes: int = 3, limit: float = S.MERGE_DISTANCE, digits: int | None = None) -> DataFrame:
    """(id, group, best, margin): ``passes`` times the averages are rebuilt, those closer than the limit merged, and all glyphs assigned anew."""
    out = members
    for _ in range(passes):
        protos = cut(averages(df.join(out.select(id_col, group_col), id_col), group_col))
        kept = merge_close(protos, group_col, limit)
        merged = averages(protos.join(kept, group_col).select(F.col("kept_as").alias(group_col), "glyph"), group_col)
        out = cut(nearest(df, merged, id_col, group_col, digits))
    return out


def dissolve(df: DataFrame, members: DataFrame, id_col: str, group_col: str, least: int = S.MIN_MEMBERS, digits: int | None = None) -> DataFrame:
    """(id, group): the members of groups below ``least`` go to the nearest of the others, as all glyphs then do; unchanged if none or all are below."""
    members = cut(members.select(id_col, group_col))
    sizes = members.groupBy(group_col).agg(F.count("*").alias("n"))
    small, large = sizes.agg(F.count_if(F.col("n") < least), F.count_if(F.col("n") >= least)).first()
    if not small or not large:
        return members
    protos = averages(df.join(members, id_col).join(sizes.where(F.col("n") >= least).select(group_col), group_col), group_col)
    return nearest(df, protos, id_col, group_col, digits).select(id_col, group_col)


def survivors(members: DataFrame, group_col: str, least: int = S.MIN_MEMBERS) -> DataFrame:
    """(group, members, rank): groups with enough members, all of them if none has, the largest first, renumbered from 0."""
    sizes = cut(members.groupBy(group_col).agg(F.count("*").alias("members")))
    enough = sizes.where(F.col("members") >= least)
    return numbered(enough if enough.limit(1).count() else sizes, [F.desc("members"), F.asc(group_col)], "rank")


def match_examples(df: DataFrame, examples: DataFrame, id_col: str) -> DataFrame:
    """Name each glyph (id, glyph, r, g, b) by its nearest example (example_id, digit, glyph, er, eg, eb), shape and colour together.

    Digits, not examples, compete for the margin.
    """
    met, packs = _met(df.select(id_col, "glyph", "r", "g", "b"), examples.select("example_id", "digit", "glyph", "er", "eg", "eb"), "example_id")

    def one(t):
        gap = F.sqrt(sum((F.col(c) - t[f"e{c}"]) * (F.col(c) - t[f"e{c}"]) for c in "rgb"))
        return F.struct((soft_distance(F.col("glyph"), t["glyph"]) + S.COLOUR_WEIGHT * gap / S.COLOUR_SCALE).alias("distance"), t["digit"].alias("digit"))

    scored = met.select(id_col, F.array_sort(F.transform("protos", one)).alias("d"))
    if packs > 1:
        scored = scored.groupBy(id_col).agg(F.array_sort(F.flatten(F.collect_list("d"))).alias("d"))
    others = F.filter("d", lambda x: x["digit"] != F.get("d", F.lit(0))["digit"])  # the best of another digit is the second
    return _two(scored, id_col, "digit", F.concat(F.slice("d", 1, 1), F.slice(others, 1, 1)))
