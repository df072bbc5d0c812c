"""Points in the plane: neighbours by grid cells, greedy suppression, snapping.

Every neighbour join is an equi-join on grid cells with an exact distance filter after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtally import settings as S
from glyphtally.functions.numeric import round_half_up
from glyphtally.operators.lineage import order_statistics
from glyphtally.operators.vectors import settle


def _cell(c: str, size: Column) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def near_pairs(left: DataFrame, right: DataFrame, group: str, size: Column) -> DataFrame:
    """Pairs of the same group whose cells of ``size`` touch, with their distance.

    left (group, id, x, y, ...), right (group, rid, rx, ry, ...); ``size`` is an expression of either side's columns.
    """
    a = left.select("*", _cell("x", size).alias("gx"), _cell("y", size).alias("gy"))
    for g in ("gx", "gy"):
        a = a.withColumn(g, F.explode(F.sequence(F.col(g) - 1, F.col(g) + 1)))
    b = right.select("*", _cell("rx", size).alias("gx"), _cell("ry", size).alias("gy")).drop(*[c for c in left.columns if c in right.columns and c != group])
    d = F.sqrt((F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry")))
    return a.join(b, [group, "gx", "gy"]).withColumn("distance", d).drop("gx", "gy")


def _length(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _kept(points: DataFrame) -> list[str]:
    """Columns that a length may depend on."""
    return [c for c in ("pitch",) if c in points.columns]


def as_right(points: DataFrame) -> DataFrame:
    return points.withColumnsRenamed({"id": "rid", "x": "rx", "y": "ry"})


def neighbour_spacing(points: DataFrame, group: str, least: int = 8) -> DataFrame:
    """(group, spacing): median distance to the nearest neighbour within touching cells; 0 with fewer than ``least``."""
    box = points.groupBy(group).agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), F.count("*").alias("n"))
    side = F.greatest(F.lit(8.0), F.sqrt(F.greatest(F.lit(1.0), F.col("w") * F.col("h")) / F.col("n")) * 2)
    placed = points.join(box.select(group, side.alias("side")), group)
    pairs = near_pairs(placed, as_right(placed), group, F.col("side")).where("id <> rid")
    near = pairs.groupBy(group, "id").agg(F.min("distance").alias("d"))
    mid = order_statistics(near, group, "d", {"spacing": round_half_up(0.5 * (F.col("n") - 1))}).where(F.col("n") >= least)
    return points.select(group).distinct().join(mid.select(group, "spacing"), group, "left").na.fill(0.0, ["spacing"])


def snap(taps: DataFrame, points: DataFrame, group: str, reach: Column | float) -> DataFrame:
    """(group, id, hit, distance): the nearest point closer than ``reach`` to each tap; the first on ties. ``reach`` may be an expression of ``pitch``, which both sides have then."""
    pairs = near_pairs(taps, as_right(points), group, _length(reach)).where(F.col("distance") < _length(reach))
    best = pairs.groupBy(group, "id").agg(F.min(F.struct("distance", "rid")).alias("b"))
    return taps.select(group, "id").join(best, [group, "id"], "left").select(group, "id", F.col("b.rid").alias("hit"), F.col("b.distance").alias("distance"))


def far_from(points: DataFrame, others: DataFrame, group: str, reach: Column | float) -> DataFrame:
    """Points with no other point closer than ``reach``, which may be an expression of ``pitch``."""
    side = lambda df: df.select(group, "id", "x", "y", *_kept(df))
    near = near_pairs(side(points), as_right(side(others)), group, _length(reach))
    return points.join(near.where(F.col("distance") < _length(reach)).select(group, "id").distinct(), [group, "id"], "left_anti")


def suppress(points: DataFrame, group: str, limit: Column | float) -> DataFrame:
    """(id, kept_as): greedy suppression by ``rank`` (high first, then id): an item stands if no standing one is closer than ``limit``, which may be an expression of ``pitch``."""
    held = points.select(group, "id", "x", "y", "rank", *_kept(points))
    other = as_right(held).withColumnRenamed("rank", "rrank")
    pairs = near_pairs(held, other, group, _length(limit)).where((F.col("distance") < _length(limit)) & (F.col("id") != F.col("rid")))
    before = (F.col("rrank") > F.col("rank")) | ((F.col("rrank") == F.col("rank")) & (F.col("rid") < F.col("id")))
    return settle(held.select("id"), pairs.where(before).select(F.col("rid").alias("a"), F.col("id").alias("b")))


def size_band(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows within SIZE_LOW to SIZE_HIGH times their group's upper median; all rows of small groups."""
    mid = order_statistics(df, group, value, {"__mid": F.floor(F.col("n") / 2)}).withColumnRenamed("n", "__n")
    keep = (F.col("__n") < S.SIZE_POPULATION) | (F.col("__mid") <= 0) | F.col(value).between(F.col("__mid") * S.SIZE_LOW, F.col("__mid") * S.SIZE_HIGH)
    return df.join(mid, group).where(keep).drop("__n", "__mid")


def outlier_fence(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, fence): third quartile plus three spreads, at least FENCE_DISTANCE; floor-indexed quartiles."""
    q = order_statistics(df, group, value, {"q1": F.floor(0.25 * (F.col("n") - 1)), "q3": F.floor(0.75 * (F.col("n") - 1))})
    fence = F.greatest(F.lit(S.FENCE_DISTANCE), F.col("q3") + S.FENCE_SPREAD * (F.col("q3") - F.col("q1")))
    return q.select(group, F.when(F.col("n") < S.FENCE_POPULATION, F.lit(S.FENCE_DISTANCE)).otherwise(fence).alias("fence"))


def percentiles(df: DataFrame, group: str, value: str, at: tuple = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(group, n, p5, p25, ...): values at floor(p (n - 1))."""
    return order_statistics(df, group, value, {f"p{round(100 * p)}": F.floor(p * (F.col("n") - 1)) for p in at})


def split_outliers(df: DataFrame, group: str, value: str) -> DataFrame:
    """``df`` with ``rejected``: whether the value lies beyond its group's fence."""
    fence = outlier_fence(df, group, value)
    return df.join(fence, group).withColumn("rejected", F.col(value) > F.col("fence")).drop("fence")


def hit_test(taps: DataFrame, markers: DataFrame, group: str, tolerance: float) -> DataFrame:
    """(group, id, hit, distance): the nearest marker (group, id, x, y, radius) closer than HIT_FACTOR of its radius or the tolerance; cells are as large as the largest radius asks."""
    largest = markers.agg(F.max("radius")).first()[0] or 0.0
    reach = F.greatest(F.col("rradius") * S.HIT_FACTOR, F.lit(float(tolerance)))
    pairs = near_pairs(taps, as_right(markers).withColumnRenamed("radius", "rradius"), group, F.lit(max(float(largest) * S.HIT_FACTOR, float(tolerance)))).where(F.col("distance") < reach)
    best = pairs.groupBy(group, "id").agg(F.min(F.struct("distance", "rid")).alias("b"))
    return taps.select(group, "id").join(best, [group, "id"], "left").select(group, "id", F.col("b.rid").alias("hit"), F.col("b.distance").alias("distance"))


def within(points: DataFrame, centres: DataFrame, group: str, reach: float) -> DataFrame:
    """(group, id, rid, distance, place): the points up to ``reach`` from each centre, the nearest first."""
    pairs = near_pairs(centres, as_right(points), group, F.lit(float(reach))).where(F.col("distance") <= reach)
    return pairs.select(group, "id", "rid", "distance", F.row_number().over(Window.partitionBy(group, "id").orderBy("distance", "rid")).alias("place"))


def recall(markers: DataFrame, truth: DataFrame, group: str, radius: float) -> DataFrame:
    """(group, truth, markers, matched, recall): markers whose nearest true point lies within TRUTH_FACTOR radii, and markers per true point."""
    reach = S.TRUTH_FACTOR * radius
    near = near_pairs(markers.select(group, "id", "x", "y"), as_right(truth.select(group, "id", "x", "y")), group, F.lit(float(reach))).where(F.col("distance") <= reach)
    matched = near.groupBy(group).agg(F.count_distinct("id").alias("matched"))
    out = truth.groupBy(group).agg(F.count("*").alias("truth")).join(markers.groupBy(group).agg(F.count("*").alias("markers")), group, "left").join(matched, group, "left")
    return out.na.fill(0, ["markers", "matched"]).withColumn("recall", F.col("markers") / F.col("truth"))
