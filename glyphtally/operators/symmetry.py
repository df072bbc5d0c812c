"""Light centres of rings by radial symmetry: edges vote along their gradient, votes become a map, its peaks claim discs around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtally import settings as S
from glyphtally.functions.numeric import round_half_up
from glyphtally.operators import raster as R
from glyphtally.operators.spatial import suppress


def blur_map(maps: DataFrame, radius: int, passes: int = 2) -> DataFrame:
    """(image_id, y, x, v): maps of real values averaged over squares, ``passes`` times; edges repeat."""
    for _ in range(passes if radius >= 1 else 0):
        for at, w in (("x", R.in_row()), ("y", R.in_column())):
            whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            first, last, end = F.first("v").over(whole), F.last("v").over(whole), F.max(at).over(whole)
            inside = F.sum("v").over(w.rowsBetween(-radius, radius))
            beyond = first * F.greatest(F.lit(0), radius - F.col(at)) + last * F.greatest(F.lit(0), F.col(at) + radius - end)
            maps = maps.withColumn("v", (inside + beyond) / (2 * radius + 1))
    return maps


def radial_symmetry(px: DataFrame, radii: list[int], least: float, alpha: float = 2.0, cap: float = 0.0) -> DataFrame:
    """(image_id, y, x, v): how much edges ``radii`` away point at each pixel of gray images, the mean over the radii.

    Edges weaker than ``least`` do not vote; ``cap``, if above 0, bounds an edge's strength. All radii vote in one groupBy, and maps of radii that are blurred alike are
    added before they are blurred.
    """
    edges = R.sobel(px).where(F.col("mag") >= max(least, 1e-9)).select("image_id", "y", "x", "gy", "gx", (F.least("mag", F.lit(float(cap))) if cap > 0 else F.col("mag")).alias("m"))
    votes = edges.withColumn("radius", F.explode(F.array(*[F.lit(r) for r in radii])))
    place = lambda c, g: (F.col(c) + F.col(g) * F.col("radius") + 0.5).cast("int")
    votes = votes.select("image_id", "radius", place("y", "gy").alias("y"), place("x", "gx").alias("x"), "m").groupBy("image_id", "radius", "y", "x").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    full = F.when(F.col("radius") == 1, S.VOTE_CAPS[0]).otherwise(S.VOTE_CAPS[1])
    blur = F.greatest(F.lit(1), round_half_up(F.col("radius") * S.VOTE_BLUR)).cast("int")
    frame = votes.select("image_id", "y", "x", blur.alias("blur"), (F.pow(F.least(F.col("n"), full) / full, F.lit(alpha)) * F.col("m") / full).alias("v"))
    sizes = sorted({max(1, int(r * S.VOTE_BLUR + 0.5)) for r in radii})
    wide = frame.groupBy("image_id", "y", "x").agg(*[F.sum(F.when(F.col("blur") == b, F.col("v"))).alias(f"v{b}") for b in sizes])
    # votes beyond an image meet no pixel of it
    grid = R.by_image(px.select("image_id", "y", "x").join(wide, ["image_id", "y", "x"], "left"))
    total = F.lit(0.0)
    for b in sizes:
        held = grid.withColumn("__v", F.coalesce(f"v{b}", F.lit(0.0))).withColumn("v", F.col("__v"))
        grid = blur_map(held, b).withColumn(f"v{b}", F.col("v")).drop("v", "__v")
        total = total + F.col(f"v{b}")
    return grid.select("image_id", "y", "x", (total / len(radii)).alias("v"))


def peaks(maps: DataFrame, distance: float, threshold: Column | float) -> DataFrame:
    """(image_id, y, x, score): places at least ``threshold`` high and no lower than their eight neighbours, of which the highest claims all up to ``distance``; on ties the first by rows.

    The border has no peaks. ``threshold`` may be an expression of the map's other columns.
    """
    row, column = R.in_row().rowsBetween(-1, 1), R.in_column().rowsBetween(-1, 1)
    near = maps.withColumn("__m", F.max("v").over(row)).withColumn("__n", F.count("*").over(row))
    near = near.withColumn("__m", F.max("__m").over(column)).withColumn("__n", F.sum("__n").over(column))
    tops = near.where((F.col("__n") == 9) & (F.col("v") >= F.col("__m")) & (F.col("v") >= threshold))
    spot = F.col("y").cast("long") * F.lit(1 << 20) + F.col("x")
    points = tops.select("image_id", F.struct("image_id", spot.alias("spot")).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("v").alias("rank"))
    reach = max(1, int(distance + 0.5))
    settled = suppress(points, "image_id", (reach * reach + 0.5) ** 0.5)
    return points.join(settled.where("id = kept_as").select("id"), "id").select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("rank").alias("score"))


def map_percentile(maps: DataFrame, share: float) -> DataFrame:
    """(image_id, value): the level of a map below which ``share`` of its pixels lie, in PERCENTILE_BINS steps of its maximum; 0 for maps without positive values."""
    top = maps.groupBy("image_id").agg(F.greatest(F.lit(0.0), F.max("v")).alias("top"), F.count("*").alias("n"))
    bins = S.PERCENTILE_BINS - 1
    held = maps.join(top, "image_id").where("top > 0").groupBy("image_id", "top", "n", F.greatest(F.lit(0), F.least(F.lit(bins), (F.col("v") / F.col("top") * bins).cast("int"))).alias("bin")).agg(F.count("*").alias("k"))
    held = held.withColumn("up", F.sum("k").over(Window.partitionBy("image_id").orderBy("bin"))).where(F.col("up") >= F.col("n") * share)
    found = held.groupBy("image_id", "top").agg((F.min("bin") / bins * F.col("top")).alias("value"))
    return top.select("image_id").join(found.select("image_id", "value"), "image_id", "left").na.fill(0.0, ["value"])
