"""Markers cut out of photographs and read one by one: tiles, the radius of the light centre, the digits inside it, and readings that vote.

A tile is the square picture of one marker (image_id, y, x, v), image_id being the marker's id; all tiles of a table pass every stage together. What is tried
more than once, spokes, discs and variants, are rows of one table, reduced by a groupBy, so that nothing loops over markers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtally import settings as S
from glyphtally.functions.numeric import round_half_up
from glyphtally.operators import raster as R, reading
from glyphtally.operators.graph import attributed_holes, components
from glyphtally.operators.lineage import cut

#: Directions of the spokes (cosine, sine).
DIRECTIONS = [(round(math.cos(2 * math.pi * k / S.SPOKES), 12), round(math.sin(2 * math.pi * k / S.SPOKES), 12)) for k in range(S.SPOKES)]


def tiles(px: DataFrame, markers: DataFrame) -> DataFrame:
    """(image_id, y, x, v) of the square around each marker (image_id, id, x, y, radius), edges repeated; image_id is then the marker's id. Where the image lacks a pixel
    of its rectangle, v is null.

    Images meet markers line by line, and each marker takes its stretch of the line.
    """
    lines = R.whole(px).groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v")))["v"].alias("line"))
    size = px.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    side = round_half_up(F.greatest(F.lit(float(S.TILE_LEAST)), F.col("radius") * 2 * S.TILE_FACTOR)).cast("int")
    box = markers.join(size, "image_id").withColumn("side", side)
    box = box.withColumns({"x0": round_half_up(F.col("x") - F.col("side") / 2).cast("int"), "y0": round_half_up(F.col("y") - F.col("side") / 2).cast("int")})
    rows = box.select("image_id", "id", "side", "x0", "y0", "w", "h", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("ty"))
    met = rows.withColumn("y", F.greatest(F.lit(0), F.least("h", F.col("y0") + F.col("ty")))).join(lines, ["image_id", "y"])
    cells = F.transform(F.sequence(F.lit(0), F.col("side") - 1), lambda k: F.get("line", F.greatest(F.lit(0), F.least(F.col("w"), F.col("x0") + k))))
    return met.select(F.col("id").alias("image_id"), F.col("ty").alias("y"), F.posexplode(cells).alias("x", "v"))


def enhanced(normal: DataFrame) -> DataFrame:
    """Tiles of one size with their contrast stretched and sharpened."""
    return R.unsharp(R.auto_contrast(normal, S.TILE_CLIP), 1, S.TILE_SHARPEN)


def _median(sorted_values: Column) -> Column:
    return F.get(sorted_values, F.floor(0.5 * (F.size(sorted_values) - 1) + 0.5).cast("int"))


def centre_radius(tile: DataFrame, rings: DataFrame) -> DataFrame:
    """(image_id, radius, met): the radius of the light centre of each tile whose ring is expected at ``ring`` (image_id, ring), and how many spokes agree on it.

    Every spoke takes the first place past the light stretch that is darker than the brightest of that stretch by SPOKE_DROP. With too few spokes that meet a ring, or that
    agree with their median, the radius is NO_RING of the ring's; tiles without pixels have no row.
    """
    size = tile.groupBy("image_id").agg((F.max("x") + 1).alias("size")).join(rings.select("image_id", "ring"), "image_id")
    spokes = F.array(*[F.struct(F.lit(k).alias("spoke"), F.lit(c).alias("c"), F.lit(s).alias("s")) for k, (c, s) in enumerate(DIRECTIONS)])
    ring = F.col("ring")

    def stretch(ends: tuple[float, float], light: bool) -> Column:
        steps = F.sequence(F.lit(0), F.floor(ring * (ends[1] - ends[0]) + 1e-9).cast("int"))
        return F.transform(steps, lambda k: F.struct((ring * ends[0] + k).alias("r"), F.lit(light).alias("light")))

    middle = F.array(F.struct(F.lit(0.0).alias("r"), F.lit(True).alias("light")))
    points = size.withColumn("p", F.explode(spokes)).withColumn("q", F.explode(F.concat(middle, stretch(S.SPOKE_LIGHT, True), stretch(S.SPOKE_SEARCH, False))))
    at = lambda f: F.greatest(F.lit(0), F.least(F.col("size") - 1, round_half_up(F.col("size") / 2 + F.col(f) * F.col("q.r")).cast("int")))
    points = points.select("image_id", "ring", "p.spoke", "q.r", "q.light", at("p.s").alias("y"), at("p.c").alias("x"))
    seen = points.join(tile.select("image_id", "y", "x", "v"), ["image_id", "y", "x"])
    spoke = seen.groupBy("image_id", "ring", "spoke").agg(
        F.max(F.when(F.col("light"), F.col("v"))).alias("reference"), F.array_sort(F.collect_list(F.when(~F.col("light"), F.struct("r", "v")))).alias("scan"))
    hit = F.get(F.filter("scan", lambda s: s["v"] < F.col("reference") - S.SPOKE_DROP), F.lit(0))["r"]
    hits = spoke.withColumn("hit", hit).groupBy("image_id", "ring").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    hits = hits.withColumn("rough", _median(F.col("hits")))
    hits = hits.withColumn("agree", F.filter("hits", lambda r: F.abs(r - F.col("rough")) <= F.col("rough") * S.SPOKE_AGREE))
    enough = (F.size("hits") >= S.SPOKES_MET) & (F.size("agree") >= S.SPOKES_MET)
    low, high = S.CENTRE_RANGE
    measured = F.greatest(ring * low, F.least(ring * high, _median(F.col("agree")) * S.SPOKE_STOP))
    return hits.select("image_id", F.when(enough, measured).otherwise(ring * S.NO_RING).alias("radius"), F.when(enough, F.size("agree")).otherwise(0).alias("met"))


def discs(radii: DataFrame) -> DataFrame:
    """(image_id, turn, disc): the radii tried for each tile: the measured one (image_id, radius), then DISC_SHARES of its ring."""
    ring = F.col("radius") / S.NO_RING
    return radii.select("image_id", F.posexplode(F.array(F.col("radius"), *[ring * s for s in S.DISC_SHARES])).alias("turn", "disc"))


def isolated(tile: DataFrame, radii: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The digits of each tile, one or two, from the left: glyphs (image_id, place, turn, x, y, width, height, fill, holes), and their ink (image_id, place, y, x).

    Each disc is a hypothesis of its own, with its own threshold; pieces that hug the rim, that are too small or too large fall away, the two largest stay, and the
    disc whose pieces look most like digits wins, the first on ties. Tiles without a likely piece have no rows.
    """
    size = tile.groupBy("image_id").agg((F.max("x") + 1).alias("size"))
    tried = discs(radii).join(size, "image_id").withColumn("half", F.col("size") / 2)
    # two pixels around the disc: closing there sees what it would see in the whole tile
    low = F.greatest(F.lit(0), F.floor(F.col("half") - F.col("disc")) - 2).cast("int")
    high = F.least(F.col("size") - 1, F.ceil(F.col("half") + F.col("disc")) + 2).cast("int")
    tried = tried.withColumns({"low": low, "high": high})
    held = tile.join(tried, "image_id").where("x BETWEEN low AND high AND y BETWEEN low AND high")
    d = F.hypot(F.col("x") - F.col("half"), F.col("y") - F.col("half"))
    inside = (F.col("x") - F.col("half")) * (F.col("x") - F.col("half")) + (F.col("y") - F.col("half")) * (F.col("y") - F.col("half")) <= F.col("disc") * F.col("disc")
    held = cut(held.select(F.struct("image_id", "turn").alias("image_id"), (F.col("y") - F.col("low")).alias("y"), (F.col("x") - F.col("low")).alias("x"), "v", "low", "disc", d.alias("d"), inside.alias("inside")))
    pixels = held.where("inside")
    limits = R.otsu(pixels).join(pixels.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") >= S.DISC_PIXELS), "image_id").select("image_id", "threshold")
    mask = held.join(limits, "image_id").select("image_id", "y", "x", F.when(F.col("inside") & (F.col("v") <= F.col("threshold")), 255).otherwise(0).alias("v"))
    mask = cut(R.close(R.by_image(mask)))
    named = cut(components(mask.where("v > 0")).join(held.select("image_id", "y", "x", "low", "disc", "d"), ["image_id", "y", "x"]))

    pieces = named.groupBy("image_id", "label", "disc", "low").agg(
        F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"),
        F.min("d").alias("near"), F.max("d").alias("far"))
    disc, whole = F.col("disc"), math.pi * F.col("disc") * F.col("disc")
    likely = (
        F.col("area").between(whole * S.DISC_AREA[0], whole * S.DISC_AREA[1]) & (F.col("near") <= disc * S.DISC_NEAR) & (F.col("far") <= disc * S.DISC_FAR)
        & F.col("height").between(disc * S.DISC_HEIGHT[0], disc * S.DISC_HEIGHT[1]) & (F.col("width") <= disc * S.DISC_WIDTH))
    large = Window.partitionBy("image_id").orderBy(F.desc(F.col("width") * F.col("height")), "x", "label")
    kept = pieces.where(likely).withColumn("rank", F.row_number().over(large)).where("rank <= 2")
    kept = cut(kept.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy("x", "label")) - 1).withColumn("fill", F.col("area") / (F.col("width") * F.col("height"))))

    one = lambda value, limits, worth: F.when((value > limits[0]) & (value < limits[1]), worth[0]).otherwise(worth[1])
    worth = one(F.col("height") / disc, S.TALL, S.TALL_WORTH) + one(F.col("fill"), S.FULL, S.FULL_WORTH)
    scores = kept.groupBy("image_id").agg((F.when(F.count("*") == 1, S.DISC_WORTH[0]).otherwise(S.DISC_WORTH[1]) + F.sum(worth)).alias("score"))
    best = scores.groupBy("image_id.image_id").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("image_id.turn")).alias("turn")))["turn"].alias("turn"))
    best = best.select(F.struct("image_id", (-F.col("turn")).alias("turn")).alias("image_id"))
    chosen = cut(kept.join(best, "image_id"))
    counters = attributed_holes(mask.join(best, "image_id"), F.col("v") > 0).select("image_id", "label", "holes")
    glyphs = chosen.join(counters, ["image_id", "label"]).select(
        "image_id.image_id", "place", "image_id.turn", (F.col("x") + F.col("low")).alias("x"), (F.col("y") + F.col("low")).alias("y"), "width", "height", "fill", "holes")
    ink = named.join(chosen.select("image_id", "label", "place"), ["image_id", "label"])
    return glyphs, ink.select("image_id.image_id", "place", (F.col("y") + F.col("low")).alias("y"), (F.col("x") + F.col("low")).alias("x"))


def fitted(glyphs: DataFrame, ink: DataFrame, size: int = S.GLYPH_SIZE, margin: int = S.GLYPH_MARGIN) -> DataFrame:
    """(image_id, place, y, x): cells of a size x size raster of which at least CELL_SHARE of the source is ink, proportions kept, in the middle.

    Rows and columns of the raster each know the source lines under them, so the sums are equi-joins.
    """
    scale = (size - 2 * margin) / F.greatest("width", "height")
    box = glyphs.select("image_id", "place", F.col("x").alias("x0"), F.col("y").alias("y0"), "width", "height",
                        *[F.greatest(F.lit(1), round_half_up(F.col(n) * scale)).cast("int").alias(d) for n, d in (("width", "dw"), ("height", "dh"))])

    def covered(length: str, target: str, first: str, at: str, source: str) -> DataFrame:
        lines = box.select("image_id", "place", length, target, first, F.explode(F.sequence(F.lit(0), F.col(target) - 1)).alias("t"))
        begin, end = F.floor(F.col("t") * F.col(length) / F.col(target)), F.floor((F.col("t") + 1) * F.col(length) / F.col(target))
        lines = lines.withColumn("begin", begin.cast("int")).withColumn("end", F.greatest(begin + 1, end).cast("int"))
        offset = F.floor((size - F.col(target)) / 2).cast("int")
        return lines.select("image_id", "place", (F.col("t") + offset).alias(at), (F.col("end") - F.col("begin")).alias(f"n_{at}"),
                            F.explode(F.sequence(F.col(first) + F.col("begin"), F.col(first) + F.col("end") - 1)).alias(source))

    down, across = covered("height", "dh", "y0", "dy", "y"), covered("width", "dw", "x0", "dx", "x")
    share = ink.join(down, ["image_id", "place", "y"]).join(across, ["image_id", "place", "x"]).groupBy("image_id", "place", "dy", "dx").agg((F.count("*") / (F.first("n_dy") * F.first("n_dx"))).alias("share"))
    return share.where(F.col("share") >= S.CELL_SHARE).select("image_id", "place", F.col("dy").alias("y"), F.col("dx").alias("x"))


def read_glyphs(glyphs: DataFrame, ink: DataFrame, allowed: list[int] | None = None) -> DataFrame:
    """(image_id, value, confidence, glyphs) of tiles with one or two isolated digits."""
    spark = glyphs.sparkSession
    key = F.struct("image_id", "place").alias("image_id")
    rasters, size = cut(fitted(glyphs, ink).select(key, "y", "x")), S.GLYPH_SIZE
    counters = glyphs.select(key, F.col("holes").cast("long").alias("holes"))
    scores = cut(reading.similarity(reading.chamfer(rasters, reading.templates(spark, size), size, counters.select("image_id")), counters, reading.template_holes(spark, size)))
    side = lambda k: scores.where(F.col("image_id.place") == k).select("image_id.image_id", "digit", "similarity")
    count = glyphs.groupBy("image_id").agg(F.count("*").alias("glyphs"))
    return reading.combined(side(0), side(1), allowed).join(count, "image_id")


def voted(attempts: DataFrame) -> DataFrame:
    """(image_id, value, confidence, agreeing) from readings (image_id, turn, value, confidence): the surest one with a value, the first on ties; surer by AGREEMENT where
    another agrees. Without any such reading the value is null and the confidence 0."""
    sure = F.col("value").isNotNull() & (F.col("confidence") > 0)
    best = F.max(F.when(sure, F.struct("confidence", (-F.col("turn")).alias("turn"), "value"))).alias("b")
    held = attempts.groupBy("image_id").agg(best, F.collect_list("value").alias("values"))
    agreeing = F.size(F.filter("values", lambda v: v == F.col("b.value")))
    held = held.select("image_id", F.col("b.value").alias("value"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("b").isNull(), 0).otherwise(agreeing).alias("agreeing"))
    return held.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") * F.when(F.col("agreeing") >= 2, S.AGREEMENT).otherwise(1.0)))


def read_markers(px: DataFrame, markers: DataFrame, allowed: list[int] | None = None, size: int = S.TILE_SIZE) -> DataFrame:
    """(id, value, confidence, agreeing, radius, met) of markers (image_id, id, x, y, radius) on gray images (image_id, y, x, v).

    Tiles are brought to size x size; their digits are looked for in the sharpened tile and in the plain one, and the two readings vote. Markers of images that are
    not there, and those without a likely digit, read as null with confidence 0.
    """
    allowed = allowed if allowed and len(set(allowed)) < len(S.SUPPORTED_NUMBERS) else None
    normal = cut(R.by_image(R.resample(tiles(px, markers), size)))
    sharp = cut(enhanced(normal))
    rings = normal.select("image_id").distinct().withColumn("ring", F.lit(size / S.TILE_FACTOR))
    radii = cut(centre_radius(sharp, rings))
    # both variants pass the stages as tiles of their own
    variant = lambda df, k: df.withColumn("image_id", F.struct("image_id", F.lit(k).alias("variant")))
    both = variant(sharp, 0).unionByName(variant(normal, 1).select(*sharp.columns))
    glyphs, ink = isolated(both, variant(radii, 0).unionByName(variant(radii, 1)))
    glyphs = cut(glyphs)
    found = read_glyphs(glyphs, ink, allowed)
    attempts = found.select("image_id.image_id", F.col("image_id.variant").alias("turn"), "value", "confidence")
    out = markers.select("id").join(voted(attempts).withColumnRenamed("image_id", "id"), "id", "left").na.fill(0, ["confidence", "agreeing"])
    return out.join(radii.withColumnRenamed("image_id", "id"), "id", "left")
