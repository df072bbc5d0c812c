"""Raster operators on long tables (image_id, y, x, v).

All windows clamp at the borders. Tables are dealt by image once; the windows over rows and columns
then need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtally import settings as S
from glyphtally.functions.numeric import clamp8


def in_row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def in_column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def by_image(px: DataFrame) -> DataFrame:
    return px.repartition("image_id")


def whole(px: DataFrame) -> DataFrame:
    """``px`` with the pixels that images lack of their rectangle from (0, 0) on, their levels null; images that lack none pass."""
    size = px.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"), F.count("*").alias("n"))
    short = size.where("n < (h + 1) * (w + 1)")
    grid = short.select("image_id", "w", F.explode(F.sequence(F.lit(0), "h")).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), "w")).alias("x"))
    held = px.join(short.select("image_id"), "image_id", "left_semi").select("image_id", "y", "x")
    lacking = grid.join(held, ["image_id", "y", "x"], "left_anti").withColumn("v", F.lit(None).cast(px.schema["v"].dataType))
    return px.select("image_id", "y", "x", "v").unionByName(lacking)


def windowed(px: DataFrame, radius: int, fold=F.sum, **columns: Column) -> DataFrame:
    """Each named column folded over the (2 radius + 1)-square window."""
    flat = px.select("*", *[fold(c).over(in_row().rowsBetween(-radius, radius)).alias(f"__{k}") for k, c in columns.items()])
    return flat.select(*px.columns, *[fold(f"__{k}").over(in_column().rowsBetween(-radius, radius)).alias(k) for k in columns])


def luma(r: Column, g: Column, b: Column) -> Column:
    return clamp8((299 * r + 587 * g + 114 * b) / 1000)


def invert(v: Column) -> Column:
    return 255 - v


def box_blur(px: DataFrame, radius: int) -> DataFrame:
    if radius < 1:
        return px
    out = windowed(px, radius, s=F.col("v"), n=F.lit(1))
    return out.withColumn("v", clamp8(F.col("s") / F.col("n"))).drop("s", "n")


def smooth(px: DataFrame, radius: int) -> DataFrame:
    """Two box blurs, rounded in between."""
    return box_blur(box_blur(px, radius), radius)


def _with_smooth(px: DataFrame, radius: int) -> DataFrame:
    """``px`` with its smoothed value as ``s``."""
    return smooth(px.withColumn("__v", F.col("v")), radius).withColumnRenamed("v", "s").withColumnRenamed("__v", "v")


def flatten(px: DataFrame, radius: int, strength: float = 1.0) -> DataFrame:
    flat = F.col("v") - F.col("s") + 128
    return _with_smooth(px, radius).withColumn("v", clamp8(F.col("v") * (1 - strength) + flat * strength)).drop("s")


def unsharp(px: DataFrame, radius: int = 1, amount: float = 0.8) -> DataFrame:
    return _with_smooth(px, radius).withColumn("v", clamp8(F.col("v") + amount * (F.col("v") - F.col("s")))).drop("s")


def local_mean_std(px: DataFrame, radius: int) -> DataFrame:
    out = windowed(px, radius, s=F.col("v"), q=F.col("v") * F.col("v"), n=F.lit(1))
    mean = F.col("s") / F.col("n")
    out = out.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)))
    return out.drop("s", "q", "n")


def sauvola(px: DataFrame, radius: int) -> DataFrame:
    """``ink``: darker than the local threshold."""
    limit = F.col("mean") * (1 + S.SAUVOLA_K * (F.col("std") / S.SAUVOLA_RANGE - 1))
    return local_mean_std(px, radius).withColumn("ink", F.col("v") <= limit)


def auto_contrast(px: DataFrame, clip_percent: float = 0.5) -> DataFrame:
    hist = px.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    up, all_ = Window.partitionBy("image_id").orderBy("v"), Window.partitionBy("image_id")
    hist = hist.select("image_id", "v", F.sum("n").over(up).alias("below"), F.sum("n").over(all_).alias("total"), "n")
    clip = F.col("total") * clip_percent / 100
    ends = hist.groupBy("image_id").agg(
        F.min(F.when(F.col("below") > clip, F.col("v"))).alias("lo"), F.max(F.when(F.col("total") - F.col("below") + F.col("n") > clip, F.col("v"))).alias("hi"))
    wide = F.col("hi") - F.col("lo")
    out = F.when(wide < 16, F.col("v")).otherwise(clamp8((F.col("v") - F.col("lo")) * 255 / F.greatest(F.lit(1), wide)))
    ends = ends.withColumn("lo", F.coalesce("lo", F.lit(0))).withColumn("hi", F.coalesce("hi", F.lit(255)))  # nothing above the clip: the whole range
    return px.join(ends, "image_id").withColumn("v", out).drop("lo", "hi")


def otsu(px: DataFrame) -> DataFrame:
    """(image_id, threshold): the lowest level of the greatest between-class variance."""
    hist = px.groupBy("image_id", "v").agg(F.count("*").cast("double").alias("n"))
    up, all_ = Window.partitionBy("image_id").orderBy("v"), Window.partitionBy("image_id")
    moment = F.col("v") * F.col("n")
    hist = hist.select(
        "image_id", "v", F.sum("n").over(up).alias("wb"), F.sum(moment).over(up).alias("sb"), F.sum("n").over(all_).alias("total"), F.sum(moment).over(all_).alias("sum"))
    front = F.col("total") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - F.when(front > 0, (F.col("sum") - F.col("sb")) / F.greatest(front, F.lit(1.0)))
    between = F.col("wb") * front * gap * gap
    best = F.max(F.when(front > 0, F.struct(between.alias("b"), (-F.col("v")).alias("v"))))
    return hist.groupBy("image_id").agg(F.coalesce(-best["v"], F.lit(0)).alias("threshold"))


def dilate(mask: DataFrame) -> DataFrame:
    return windowed(mask, 1, F.max, m=F.col("v")).withColumn("v", F.col("m")).drop("m")


def erode(mask: DataFrame) -> DataFrame:
    """Off where any of the nine is off; beyond the border counts as off."""
    out = windowed(windowed(mask, 1, F.min, m=F.col("v")), 1, n=F.lit(1))
    return out.withColumn("v", F.when(F.col("n") == 9, F.col("m")).otherwise(0)).drop("m", "n")


def close(mask: DataFrame) -> DataFrame:
    return erode(dilate(mask))


def sobel(px: DataFrame) -> DataFrame:
    """gx, gy (a unit vector) and magnitude; zero at the border."""
    across = px.select("*", F.lag("v").over(in_row()).alias("l"), F.lead("v").over(in_row()).alias("r"))
    across = across.withColumn("d", F.col("r") - F.col("l")).withColumn("s", F.col("l") + 2 * F.col("v") + F.col("r"))
    up, down = (lambda c: F.lag(c).over(in_column())), (lambda c: F.lead(c).over(in_column()))
    out = across.withColumn("gx0", up("d") + 2 * F.col("d") + down("d")).withColumn("gy0", down("s") - up("s"))
    edge = F.col("gx0").isNull() | F.col("gy0").isNull()
    mag = F.when(edge, 0.0).otherwise(F.sqrt((F.col("gx0") * F.col("gx0") + F.col("gy0") * F.col("gy0")).cast("double")))
    unit = lambda c: F.when(F.col("mag") > 1e-3, F.col(c) / F.col("mag")).otherwise(0.0)
    return out.withColumn("mag", mag).withColumn("gx", unit("gx0")).withColumn("gy", unit("gy0")).drop("l", "r", "d", "s", "gx0", "gy0")


def downscale(px: DataFrame, factor: int) -> DataFrame:
    cell = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("y", "x")]
    return px.groupBy("image_id", *cell).agg(clamp8(F.avg("v")).alias("v"))


def _size(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def _covers(source: str, length: str, ratio: Column):
    """Whether target line t covers the source line: from floor(t ratio) to before floor((t + 1) ratio), one line at least."""
    return lambda t: (F.floor(t * ratio) <= F.col(source)) & (F.col(source) < F.least(F.col(length), F.greatest(F.floor(t * ratio) + 1, F.floor((t + 1) * ratio))))


def downscale_by(px: DataFrame, scale: Column | float, values: tuple = ("v",), size: DataFrame | None = None) -> DataFrame:
    """Images shrunk by ``scale`` (a number, or an expression of height h and width w), each target pixel the mean of the source pixels under it; unchanged from 1 on.

    ``size`` (image_id, h, w) tells the images' heights and widths, where their pixels may not reach the last line. A source line belongs to at most two target lines, as targets may overlap by rounding, so the means are a groupBy.
    """
    scale = F.lit(scale) if isinstance(scale, (int, float)) else scale
    size = (_size(px) if size is None else size).withColumn("scale", F.least(F.lit(1.0), scale))
    size = size.select("image_id", *[c for n, d in (("h", "dh"), ("w", "dw")) for c in (F.col(n), F.greatest(F.lit(1), F.floor(F.col(n) * F.col("scale") + 0.5)).alias(d))])
    met = px.join(size, "image_id")
    for source, n, d, out in (("y", "h", "dh", "ty"), ("x", "w", "dw", "tx")):
        ratio = F.col(n) / F.col(d)
        guess = F.floor((F.col(source) + 0.5) / ratio)
        near = F.filter(F.sequence(F.greatest(F.lit(0), guess - 1), F.least(F.col(d) - 1, guess + 1)), _covers(source, n, ratio))
        met = met.withColumn(out, F.explode(near)).withColumn(out, F.col(out).cast("int"))
    return met.groupBy("image_id", F.col("ty").alias("y"), F.col("tx").alias("x")).agg(*[clamp8(F.avg(v)).alias(v) for v in values])


def _cubic(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    a, b, c = -0.5 * p0 + 1.5 * p1 - 1.5 * p2 + 0.5 * p3, p0 - 2.5 * p1 + 2 * p2 - 0.5 * p3, -0.5 * p0 + 0.5 * p2
    return ((a * t + b) * t + c) * t + p1


def upscale(px: DataFrame, height: int, width: int) -> DataFrame:
    """height x width by the Catmull-Rom cubic, along rows and then columns; taps beyond the border repeat the edge pixel."""
    size = _size(px)

    def stretched(df: DataFrame, along: str, other: str, length: str, target: int) -> DataFrame:
        lines = df.groupBy("image_id", other).agg(F.transform(F.array_sort(F.collect_list(F.struct(along, "v"))), lambda s: s["v"].cast("double")).alias("line"))
        lines = lines.join(size.select("image_id", F.col(length).alias("n")), "image_id").withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(target - 1))))
        at = (F.col("to") + 0.5) * (F.col("n") / target) - 0.5
        lines = lines.withColumn("at", at).withColumn("from", F.floor("at").cast("int"))
        tap = lambda k: F.element_at("line", F.greatest(F.lit(0), F.least(F.col("n") - 1, F.col("from") + k)).cast("int") + 1)
        return lines.select("image_id", other, F.col("to").alias(along), _cubic(tap(-1), tap(0), tap(1), tap(2), F.col("at") - F.col("from")).alias("v"))

    return stretched(stretched(px, "x", "y", "w", width), "y", "x", "h", height).withColumn("v", clamp8(F.col("v")))


def resample(px: DataFrame, side: int, size: DataFrame | None = None) -> DataFrame:
    """Square images as side x side: smaller ones through the cubic, larger ones through means.

    ``size`` (image_id, h, w) tells the edges of images that may lack pixels; by default the last pixels do. Target pixels of a larger image over nothing are left out.
    """
    size = _size(px) if size is None else size
    small = px.join(size.where(F.col("w") < side), "image_id", "left_semi")
    large = px.join(size.where(F.col("w") >= side), "image_id", "left_semi")
    return upscale(small, side, side).unionByName(downscale_by(large, F.lit(float(side)) / F.col("w"), size=size))


def bilinear(px: DataFrame, points: DataFrame) -> DataFrame:
    """(image_id, id, v) at points (image_id, id, y, x) between pixels: four clamped taps, weighted."""
    at = points.join(_size(px), "image_id").withColumn("fy", F.col("y") - F.floor("y")).withColumn("fx", F.col("x") - F.floor("x"))
    taps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    at = at.withColumn("t", F.explode(taps))
    inside = lambda c, n, k: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.floor(c).cast("int") + F.col(k)))
    part = lambda f, k: F.when(F.col(k) == 1, F.col(f)).otherwise(1 - F.col(f))
    at = at.select("image_id", "id", inside("y", "h", "t.a").alias("y"), inside("x", "w", "t.b").alias("x"), (part("fy", "t.a") * part("fx", "t.b")).alias("weight"))
    return at.join(px, ["image_id", "y", "x"]).groupBy("image_id", "id").agg(F.sum(F.col("v") * F.col("weight")).alias("v"))


def fingerprint(px: DataFrame) -> DataFrame:
    """(image_id, signature): width, height and the 32-bit FNV-1a fold, in base 36, of a sparse grid of about 32 x 32 colour pixels (r, g, b)."""
    step = lambda n: F.greatest(F.lit(1), F.floor(F.col(n) / 32))
    grid = px.join(_size(px), "image_id").where((F.col("y") % step("h") == 0) & (F.col("x") % step("w") == 0))
    code = F.col("r") + F.col("g") * 256 + F.col("b") * 65536
    rows = grid.groupBy("image_id", "h", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", code.cast("long").alias("c")))), lambda s: s["c"]).alias("codes"))
    fold = F.aggregate("codes", F.lit(2166136261), lambda h, v: F.pmod(h.bitwiseXOR(v) * F.lit(16777619), F.lit(4294967296)))
    return rows.select("image_id", F.concat(F.col("w").cast("string"), F.lit("x"), F.col("h").cast("string"), F.lit("-"), F.lower(F.conv(fold.cast("string"), 10, 36))).alias("signature"))


def disc_otsu(px: DataFrame, centres: DataFrame) -> DataFrame:
    """(image_id, threshold) by the pixels within ``radius`` of a centre (image_id, cy, cx, radius) alone; 128 with 16 or fewer."""
    met = px.join(centres, "image_id")
    inside = met.where((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) <= F.col("radius") * F.col("radius"))
    enough = inside.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 16").select("image_id")
    found = otsu(inside.select("image_id", "y", "x", "v").join(enough, "image_id"))
    return centres.select("image_id").join(found, "image_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(128)))


def crop_clamped(px: DataFrame, top: int, left: int, side: int) -> DataFrame:
    """A side x side crop; beyond the border the nearest pixel repeats."""
    size = px.groupBy("image_id").agg((F.max("y")).alias("h"), F.max("x").alias("w"))
    grid = size.select("*", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("oy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("ox"))
    grid = grid.withColumn("y", F.greatest(F.lit(0), F.least("h", F.col("oy") + top))).withColumn("x", F.greatest(F.lit(0), F.least("w", F.col("ox") + left)))
    return grid.join(px, ["image_id", "y", "x"]).select("image_id", F.col("oy").alias("y"), F.col("ox").alias("x"), "v")


def _placed(px: DataFrame) -> DataFrame:
    """``px`` (with orientation) and the place ny, nx of every pixel when its image is set upright."""
    size = px.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    at = px.join(size, "image_id")
    x, y, rx, ry = F.col("x"), F.col("y"), F.col("w") - F.col("x"), F.col("h") - F.col("y")
    places = {1: (x, y), 2: (rx, y), 3: (rx, ry), 4: (x, ry), 5: (y, x), 6: (ry, x), 7: (ry, rx), 8: (y, rx)}
    pick = lambda k: F.coalesce(*[F.when(F.col("orientation") == o, p[k]) for o, p in places.items()], places[1][k])
    return at.withColumn("nx", pick(0)).withColumn("ny", pick(1)).drop("h", "w")


def oriented(px: DataFrame) -> DataFrame:
    """Every pixel at its place under each of the eight EXIF orientations: orientation, ny, nx."""
    return _placed(px.withColumn("orientation", F.explode(F.array(*[F.lit(k) for k in range(1, 9)]))))


def upright(px: DataFrame, orientations: DataFrame) -> DataFrame:
    """Images turned upright by their orientations (image_id, orientation); others than 2 to 8 change nothing."""
    placed = _placed(px.join(orientations, "image_id", "left").withColumn("orientation", F.coalesce("orientation", F.lit(1))))
    return placed.drop("orientation", "y", "x").withColumnsRenamed({"ny": "y", "nx": "x"})


def lag_scores(px: DataFrame, lags: range, radius: int) -> DataFrame:
    """(image_id, lag, score): mean product of pixels a lag apart, on flattened images, every other row and column."""
    flat = flatten(px, radius)
    flat = flat.withColumn("d", F.col("v") - F.avg("v").over(Window.partitionBy("image_id")))
    parts = []
    for lag in lags:
        right = F.when((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0), F.col("d") * F.lead("d", lag).over(in_row()))
        down = F.when((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0), F.col("d") * F.lead("d", lag).over(in_column()))
        parts += [right.alias(f"r{lag}"), down.alias(f"c{lag}")]
    wide = flat.select("image_id", *parts)
    sums = wide.groupBy("image_id").agg(*[F.struct(F.lit(k).alias("lag"), ((F.coalesce(F.sum(f"r{k}"), F.lit(0.0)) + F.coalesce(F.sum(f"c{k}"), F.lit(0.0))) / F.greatest(F.lit(1), F.count(f"r{k}") + F.count(f"c{k}"))).alias("score")).alias(f"s{k}") for k in lags])
    return sums.select("image_id", F.explode(F.array(*[f"s{k}" for k in lags])).alias("s")).select("image_id", "s.lag", "s.score")


def pitch_peak(scores: DataFrame) -> DataFrame:
    """(image_id, pitch, strength): the earliest serious peak above the median score, placed by a parabola, and how far the strongest stands out; 0 without one."""
    w, all_ = Window.partitionBy("image_id").orderBy("lag"), Window.partitionBy("image_id")
    s = scores.select("*", F.lag("score").over(w).alias("a"), F.lead("score").over(w).alias("c"), F.row_number().over(Window.partitionBy("image_id").orderBy("score")).alias("k"), F.count("*").over(all_).alias("n"))
    s = s.withColumn("baseline", F.max(F.when(F.col("k") == F.floor(0.5 * (F.col("n") - 1) + 0.5) + 1, F.col("score"))).over(all_))
    peaks = s.where((F.col("score") > F.col("a")) & (F.col("score") >= F.col("c")) & (F.col("score") > F.col("baseline")))
    peaks = peaks.withColumn("top", F.max("score").over(all_)).where(F.col("score") >= 0.5 * F.col("top"))
    first = peaks.groupBy("image_id").agg(F.min(F.struct("lag", "a", "score", "c", "top", "baseline")).alias("p")).select("image_id", "p.*")
    bend = F.col("a") - 2 * F.col("score") + F.col("c")
    shift = F.when(bend != 0, 0.5 * (F.col("a") - F.col("c")) / F.when(bend != 0, bend))
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("top") - F.col("baseline")) / (F.abs("top") + 1e-6)))
    first = first.select("image_id", (F.col("lag") + F.when(F.abs(shift) < 1, shift).otherwise(0.0)).alias("pitch"), strength.alias("strength"))
    return scores.select("image_id").distinct().join(first, "image_id", "left").na.fill(0.0, ["pitch", "strength"])


def rim_colour(px: DataFrame, centres: DataFrame, inner: float = S.RIM_INNER, outer: float = S.RIM_OUTER) -> DataFrame:
    """(image_id, marker_id, r, g, b): mean colour of the ring around each centre (image_id, marker_id, cy, cx, pitch).

    Pixels meet centres by grid cells of the largest reach, so the join is an equi-join.
    """
    reach = centres.agg(F.max(F.col("pitch") * outer)).first()[0] or 1.0
    cell = lambda c: F.floor(F.col(c) / F.lit(float(reach))).cast("long")
    near = centres.select("*", cell("cy").alias("gy"), cell("cx").alias("gx"))
    for g in ("gy", "gx"):
        near = near.withColumn(g, F.explode(F.sequence(F.col(g) - 1, F.col(g) + 1)))
    met = px.select("*", cell("y").alias("gy"), cell("x").alias("gx")).join(near, ["image_id", "gy", "gx"])
    d2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    ring = met.where((d2 >= F.pow(F.col("pitch") * inner, F.lit(2))) & (d2 <= F.pow(F.col("pitch") * outer, F.lit(2))))
    ring = ring.groupBy("image_id", "marker_id").agg(*[F.avg(c).alias(c) for c in "rgb"])
    return centres.select("image_id", "marker_id").join(ring, ["image_id", "marker_id"], "left").na.fill(0.0, ["r", "g", "b"])
