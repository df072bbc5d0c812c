"""Raster and graph queries over images made of the embedding table, with SQL for the same rows.

A single image is one vector as 8 x 8 gray levels; a mosaic puts 4 x 4 (or 2 x 2) vectors of consecutive ids side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtally.functions.digits import raster
from glyphtally.operators import graph, raster as R, reading
from glyphtally.sources.rasters import mosaic_pixels, vector_pixels


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def single(spark, sf_dir) -> DataFrame:
    return R.by_image(vector_pixels(_vectors(spark, sf_dir)))


def mosaic(spark, sf_dir, tiles: int = 4) -> DataFrame:
    return R.by_image(mosaic_pixels(_vectors(spark, sf_dir), tiles))


def rgb(spark, sf_dir) -> DataFrame:
    """A colour mosaic: green and blue are the red of the vector's other cells."""
    v = _vectors(spark, sf_dir).withColumn("g", F.concat(F.slice("embedding", 9, 56), F.slice("embedding", 1, 8))).withColumn("b", F.reverse("embedding"))
    px = mosaic_pixels(v, 4).withColumnRenamed("v", "r")
    for c in ("g", "b"):
        px = px.join(mosaic_pixels(v, 4, vector_col=c).withColumnRenamed("v", c), ["image_id", "y", "x"])
    return R.by_image(px)


SINGLE = """px AS MATERIALIZED (SELECT vec_id AS image_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x,
  greatest(0, least(255, round_even(128 + 256 * embedding[i]::DOUBLE, 0)))::INT AS v FROM embeddings, range(1, 65) t(i))"""


def _mosaic_sql(tiles: int, name: str = "px", value: str = "v", source: str = "embedding[i]") -> str:
    n = tiles * tiles
    return f"""{name} AS MATERIALIZED (SELECT vec_id // {n} AS image_id, ((i - 1) // 8 + 8 * ((vec_id % {n}) // {tiles}))::INT AS y, ((i - 1) % 8 + 8 * (vec_id % {tiles}))::INT AS x,
  greatest(0, least(255, round_even(128 + 256 * ({source})::DOUBLE, 0)))::INT AS {value} FROM embeddings, range(1, 65) t(i))"""


MOSAIC = _mosaic_sql(4)
RGB = ", ".join([_mosaic_sql(4, "pr", "r"), _mosaic_sql(4, "pg", "g", "embedding[(i + 7) % 64 + 1]"), _mosaic_sql(4, "pb", "b", "embedding[65 - i]"),
                 "px AS (SELECT * FROM pr JOIN pg USING (image_id, y, x) JOIN pb USING (image_id, y, x))"])
CLAMP = "greatest(0, least(255, round_even({}, 0)))::INT"


def _box(src: str, out: str, radius: int) -> str:
    """CTEs that blur ``src`` to ``out``."""
    return f"""{out}_r AS (SELECT *, sum(v) OVER w AS s1, count(*) OVER w AS n1 FROM {src} WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)),
{out}_c AS (SELECT *, sum(s1) OVER w AS s, sum(n1) OVER w AS n FROM {out}_r WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)),
{out} AS (SELECT image_id, y, x, {CLAMP.format('s::DOUBLE / n')} AS v FROM {out}_c)"""


def _smooth(src: str, out: str, radius: int) -> str:
    return _box(src, f"{out}_1", radius) + ",\n" + _box(f"{out}_1", out, radius)


def _moments(radius: int) -> str:
    return f"""a AS (SELECT *, sum(v) OVER w AS s1, sum(v * v) OVER w AS q1, count(*) OVER w AS n1 FROM px WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)),
b AS (SELECT *, sum(s1) OVER w AS s, sum(q1) OVER w AS q, sum(n1) OVER w AS n FROM a WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)),
c AS (SELECT image_id, y, x, v, s::DOUBLE / n AS mean, sqrt(greatest(0e0, q::DOUBLE / n - (s::DOUBLE / n) * (s::DOUBLE / n))) AS std FROM b)"""


OTSU = """h AS (SELECT image_id, v, count(*)::DOUBLE AS n FROM px GROUP BY ALL),
u AS (SELECT image_id, v, sum(n) OVER up AS wb, sum(v * n) OVER up AS sb, sum(n) OVER al AS total, sum(v * n) OVER al AS sm FROM h WINDOW up AS (PARTITION BY image_id ORDER BY v), al AS (PARTITION BY image_id)),
o AS (SELECT image_id, v, CASE WHEN total > wb THEN wb * (total - wb) * (sb / wb - (sm - sb) / (total - wb)) * (sb / wb - (sm - sb) / (total - wb)) END AS between_ FROM u),
th AS (SELECT image_id, coalesce(arg_min(v, (-between_, v)) FILTER (between_ IS NOT NULL), 0)::INT AS threshold FROM o GROUP BY image_id)"""

def _reach(where: str, diagonal: bool) -> str:
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if diagonal else "abs(a.y - b.y) + abs(a.x - b.x) <= 1"
    return f"""WITH RECURSIVE {SINGLE}, ink AS (SELECT image_id, y, x, y * 1048576 + x AS spot FROM px WHERE {where}),
nb AS (SELECT a.image_id, a.spot AS s, b.spot AS t FROM ink a JOIN ink b ON a.image_id = b.image_id AND {near}),
reach AS (SELECT image_id, s, t FROM nb UNION SELECT r.image_id, r.s, nb.t FROM reach r JOIN nb ON r.image_id = nb.image_id AND r.t = nb.s),
lab AS (SELECT i.image_id, y, x, min(t) AS label FROM reach r JOIN ink i ON i.image_id = r.image_id AND i.spot = r.s GROUP BY i.image_id, y, x)"""


def luma(spark, sf_dir):
    return rgb(spark, sf_dir).select("image_id", "y", "x", R.luma(F.col("r"), F.col("g"), F.col("b")).alias("v"))


def invert(spark, sf_dir):
    return single(spark, sf_dir).withColumn("v", R.invert(F.col("v")))


def box_blur(spark, sf_dir):
    return R.box_blur(mosaic(spark, sf_dir), 2)


def flatten(spark, sf_dir):
    return R.flatten(mosaic(spark, sf_dir), 3)


def unsharp(spark, sf_dir):
    return R.unsharp(mosaic(spark, sf_dir))


def auto_contrast(spark, sf_dir):
    return R.auto_contrast(mosaic(spark, sf_dir))


def sauvola_ink(spark, sf_dir):
    return R.sauvola(mosaic(spark, sf_dir), 4).select("image_id", "y", "x", "ink")


def local_contrast(spark, sf_dir):
    return R.local_mean_std(mosaic(spark, sf_dir), 2).select("image_id", "y", "x", F.round("std", 6).alias("std"))


def otsu_threshold(spark, sf_dir):
    return R.otsu(mosaic(spark, sf_dir))


def otsu_mask(spark, sf_dir):
    px = mosaic(spark, sf_dir)
    return px.join(R.otsu(px), "image_id").select("image_id", "y", "x", F.when(F.col("v") <= F.col("threshold"), 255).otherwise(0).alias("v"))


def sobel_gradient(spark, sf_dir):
    return R.sobel(mosaic(spark, sf_dir)).select("image_id", "y", "x", *[F.round(c, 6).alias(c) for c in ("mag", "gx", "gy")])


def _mask(spark, sf_dir):
    return mosaic(spark, sf_dir).withColumn("v", F.when(F.col("v") <= 120, 255).otherwise(0))


def dilate(spark, sf_dir):
    return R.dilate(_mask(spark, sf_dir))


def erode(spark, sf_dir):
    return R.erode(_mask(spark, sf_dir))


def close(spark, sf_dir):
    return R.close(_mask(spark, sf_dir))


def downscale_area(spark, sf_dir):
    return R.downscale(mosaic(spark, sf_dir), 2)


def upscale_cubic(spark, sf_dir):
    return R.upscale(single(spark, sf_dir), 16, 16)


def crop_clamped(spark, sf_dir):
    return R.crop_clamped(single(spark, sf_dir), -2, 5, 6)


def exif_orientation(spark, sf_dir):
    return R.oriented(single(spark, sf_dir)).select("image_id", "orientation", "ny", "nx", "v")


def autocorrelation(spark, sf_dir):
    return R.lag_scores(mosaic(spark, sf_dir), range(4, 11), 3).withColumn("score", F.round("score", 6))


def pitch_peak(spark, sf_dir):
    scores = R.lag_scores(mosaic(spark, sf_dir), range(4, 11), 3).withColumn("score", F.round("score", 6))
    return R.pitch_peak(scores).withColumn("pitch", F.round("pitch", 6)).withColumn("strength", F.round("strength", 6))


def rim_colour(spark, sf_dir):
    px = rgb(spark, sf_dir)
    centres = (
        px.select("image_id").distinct().withColumn("marker_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .withColumn("cy", 8 + 16 * F.floor(F.col("marker_id") / 2).cast("int")).withColumn("cx", 8 + 16 * (F.col("marker_id") % 2)).withColumn("pitch", F.lit(16.0)))
    return R.rim_colour(px, centres).select("image_id", "marker_id", *[F.round(c, 6).alias(c) for c in "rgb"])


def component_labels(spark, sf_dir):
    return graph.components(single(spark, sf_dir).where("v <= 120"))


def component_measures(spark, sf_dir):
    m = graph.measures(graph.components(single(spark, sf_dir).where("v <= 120")))
    return m.select("image_id", "component", "area", "min_x", "max_x", "min_y", "max_y", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("cx", "cy", "mu20", "mu02", "mu11")])


def hole_counts(spark, sf_dir):
    return graph.holes(single(spark, sf_dir), F.col("v") <= 140)


SIZE = 16


def chamfer_distances(spark, sf_dir):
    px = mosaic(spark, sf_dir, 2)
    return reading.chamfer(px.where("v <= 90").select("image_id", "y", "x"), reading.templates(spark, SIZE), SIZE, px).withColumn("distance", F.round("distance", 6))


def digit_reading(spark, sf_dir):
    out = reading.read_shapes(spark, mosaic(spark, sf_dir, 2), F.col("v") <= 90, SIZE)
    return out.select("image_id", "digit", F.round("similarity", 6).alias("similarity"), F.round("confidence", 5).alias("confidence"))


TEMPLATES = "tp(digit, ty, tx) AS (VALUES " + ", ".join(f"({d}, {y}, {x})" for d in range(10) for y, x in raster(d, SIZE)) + ")"
CHAMFER = f"""{_mosaic_sql(2)}, {TEMPLATES}, ik AS (SELECT image_id, y, x FROM px WHERE v <= 90),
co AS (SELECT image_id, y, x, digit, ty, tx, 3 * greatest(abs(y - ty), abs(x - tx)) + least(abs(y - ty), abs(x - tx)) AS c FROM ik, tp),
th AS (SELECT image_id, digit, avg(c) AS d FROM (SELECT image_id, digit, y, x, min(c) AS c FROM co GROUP BY ALL) GROUP BY ALL),
bk AS (SELECT image_id, digit, avg(c) AS d FROM (SELECT image_id, digit, ty, tx, min(c) AS c FROM co GROUP BY ALL) GROUP BY ALL),
dist AS (SELECT i.image_id, i.digit, coalesce((th.d / 3 + bk.d / 3) / 2, 99e0) AS distance FROM (SELECT DISTINCT image_id, digit FROM px, (SELECT DISTINCT digit FROM tp)) i LEFT JOIN th USING (image_id, digit) LEFT JOIN bk USING (image_id, digit))"""

LAGS = f"""{MOSAIC}, {_smooth('px', 'sm', 3)},
fl AS (SELECT px.image_id, px.y, px.x, {CLAMP.format('px.v - sm.v + 128')} AS v FROM px JOIN sm USING (image_id, y, x)),
dv AS (SELECT image_id, y, x, v - avg(v) OVER (PARTITION BY image_id) AS d FROM fl),
pr AS (SELECT a.image_id, lag, a.d * b.d AS p FROM dv a, range(4, 11) t(lag), dv b WHERE a.y % 2 = 0 AND a.x % 2 = 0 AND a.image_id = b.image_id AND ((b.y = a.y AND b.x = a.x + lag) OR (b.x = a.x AND b.y = a.y + lag))),
sc AS (SELECT i.image_id, lag::INT AS lag, round(coalesce(sum(p), 0e0) / greatest(1, count(p)), 6) AS score FROM (SELECT DISTINCT image_id, lag FROM px, range(4, 11) t(lag)) i LEFT JOIN pr USING (image_id, lag) GROUP BY ALL)"""

WINDOW3 = "PARTITION BY image_id, {} ORDER BY {} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"


def _morph(src: str, out: str, fold: str) -> str:
    rim = "CASE WHEN n = 9 THEN m ELSE 0 END" if fold == "min" else "m"
    return f"""{out}_r AS (SELECT *, {fold}(v) OVER w AS m1, count(*) OVER w AS n1 FROM {src} WINDOW w AS ({WINDOW3.format('y', 'x')})),
{out}_c AS (SELECT *, {fold}(m1) OVER w AS m, sum(n1) OVER w AS n FROM {out}_r WINDOW w AS ({WINDOW3.format('x', 'y')})),
{out} AS (SELECT image_id, y, x, {rim} AS v FROM {out}_c)"""


MASK = f"{MOSAIC}, mk AS (SELECT image_id, y, x, CASE WHEN v <= 120 THEN 255 ELSE 0 END AS v FROM px)"

QUERIES = {f.__name__: f for f in (
    luma, invert, box_blur, flatten, unsharp, auto_contrast, sauvola_ink, local_contrast, otsu_threshold, otsu_mask, sobel_gradient, dilate, erode, close,
    downscale_area, upscale_cubic, crop_clamped, exif_orientation, autocorrelation, pitch_peak, rim_colour, component_labels, component_measures, hole_counts,
    chamfer_distances, digit_reading)}

_CUBIC = "((({a}) * {t} + ({b})) * {t} + ({c})) * {t} + {p1}"


def _stretch(src: str, out: str, along: str, other: str) -> str:
    def cubic(p, t):
        return _CUBIC.format(a=f"-0.5e0*{p[0]}+1.5e0*{p[1]}-1.5e0*{p[2]}+0.5e0*{p[3]}", b=f"{p[0]}-2.5e0*{p[1]}+2*{p[2]}-0.5e0*{p[3]}", c=f"-0.5e0*{p[0]}+0.5e0*{p[2]}", t=t, p1=p[1])
    taps = ", ".join(f"(SELECT v FROM {src} q WHERE q.image_id = s.image_id AND q.{other} = s.{other} AND q.{along} = greatest(0, least(m.e, s.{along} + {k})))::DOUBLE AS t{k + 2}" for k in range(-2, 3))
    return f"""{out}_t AS (SELECT s.image_id, s.{other}, s.{along}, {taps} FROM {src} s JOIN (SELECT image_id, max({along}) AS e FROM {src} GROUP BY image_id) m USING (image_id)),
{out} AS (SELECT image_id, {other}, 2 * {along} AS {along}, {cubic(['t0', 't1', 't2', 't3'], '0.75e0')} AS v FROM {out}_t
  UNION ALL SELECT image_id, {other}, 2 * {along} + 1, {cubic(['t1', 't2', 't3', 't4'], '0.25e0')} FROM {out}_t)"""


ORACLES = {
    "luma": f"WITH {RGB} SELECT image_id, y, x, {CLAMP.format('(299 * r + 587 * g + 114 * b) / 1000e0')} AS v FROM px",
    "invert": f"WITH {SINGLE} SELECT image_id, y, x, 255 - v AS v FROM px",
    "box_blur": f"WITH {MOSAIC}, {_box('px', 'o', 2)} SELECT * FROM o",
    "flatten": f"WITH {MOSAIC}, {_smooth('px', 'sm', 3)} SELECT px.image_id, px.y, px.x, {CLAMP.format('px.v - sm.v + 128')} AS v FROM px JOIN sm USING (image_id, y, x)",
    "unsharp": f"WITH {MOSAIC}, {_smooth('px', 'sm', 1)} SELECT px.image_id, px.y, px.x, {CLAMP.format('px.v + 0.8e0 * (px.v - sm.v)')} AS v FROM px JOIN sm USING (image_id, y, x)",
    "auto_contrast": f"""WITH {MOSAIC}, r AS (SELECT image_id, v, count(*) OVER (PARTITION BY image_id ORDER BY v) AS up, count(*) OVER (PARTITION BY image_id ORDER BY v DESC) AS down, count(*) OVER (PARTITION BY image_id) AS n FROM px),
e AS (SELECT image_id, min(v) FILTER (up > n * 0.5e0 / 100) AS lo, max(v) FILTER (down > n * 0.5e0 / 100) AS hi FROM r GROUP BY image_id)
SELECT image_id, y, x, CASE WHEN hi - lo < 16 THEN v ELSE {CLAMP.format('(v - lo) * 255e0 / (hi - lo)')} END AS v FROM px JOIN e USING (image_id)""",
    "sauvola_ink": f"WITH {MOSAIC}, {_moments(4)} SELECT image_id, y, x, v <= mean * (1 + 0.28e0 * (std / 128e0 - 1)) AS ink FROM c",
    "local_contrast": f"WITH {MOSAIC}, {_moments(2)} SELECT image_id, y, x, round(std, 6) AS std FROM c",
    "otsu_threshold": f"WITH {MOSAIC}, {OTSU} SELECT * FROM th",
    "otsu_mask": f"WITH {MOSAIC}, {OTSU} SELECT image_id, y, x, CASE WHEN v <= threshold THEN 255 ELSE 0 END AS v FROM px JOIN th USING (image_id)",
    "sobel_gradient": f"""WITH {MOSAIC}, n AS (SELECT p.image_id, p.y, p.x, count(*) AS k, sum(q.v * (q.x - p.x) * CASE WHEN q.y = p.y THEN 2 ELSE 1 END) AS gx, sum(q.v * (q.y - p.y) * CASE WHEN q.x = p.x THEN 2 ELSE 1 END) AS gy
  FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL),
m AS (SELECT image_id, y, x, CASE WHEN k = 9 THEN gx::DOUBLE ELSE 0e0 END AS gx, CASE WHEN k = 9 THEN gy::DOUBLE ELSE 0e0 END AS gy FROM n)
SELECT image_id, y, x, round(sqrt(gx * gx + gy * gy), 6) AS mag, CASE WHEN gx * gx + gy * gy > 1e-6 THEN round(gx / sqrt(gx * gx + gy * gy), 6) ELSE 0e0 END AS gx, CASE WHEN gx * gx + gy * gy > 1e-6 THEN round(gy / sqrt(gx * gx + gy * gy), 6) ELSE 0e0 END AS gy FROM m""",
    "dilate": f"WITH {MASK}, {_morph('mk', 'o', 'max')} SELECT * FROM o",
    "erode": f"WITH {MASK}, {_morph('mk', 'o', 'min')} SELECT * FROM o",
    "close": f"WITH {MASK}, {_morph('mk', 'di', 'max')}, {_morph('di', 'o', 'min')} SELECT * FROM o",
    "downscale_area": f"WITH {MOSAIC} SELECT image_id, (y // 2)::INT AS y, (x // 2)::INT AS x, {CLAMP.format('avg(v)')} AS v FROM px GROUP BY image_id, y // 2, x // 2",
    "upscale_cubic": f"WITH {SINGLE}, {_stretch('px', 'ac', 'x', 'y')}, {_stretch('ac', 'dn', 'y', 'x')} SELECT image_id, y::INT AS y, x::INT AS x, {CLAMP.format('v')} AS v FROM dn",
    "crop_clamped": f"WITH {SINGLE} SELECT image_id, oy::INT AS y, ox::INT AS x, v FROM range(0, 6) a(oy), range(0, 6) b(ox), px WHERE px.y = greatest(0, least(7, oy - 2)) AND px.x = greatest(0, least(7, ox + 5))",
    "exif_orientation": f"""WITH {SINGLE} SELECT image_id, o::INT AS orientation, CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7 - x ELSE 7 - x END AS ny,
CASE o WHEN 1 THEN x WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y ELSE y END AS nx, v FROM px, range(1, 9) t(o)""",
    "autocorrelation": f"WITH {LAGS} SELECT * FROM sc",
    "pitch_peak": f"""WITH {LAGS}, w AS (SELECT *, lag(score) OVER o AS a, lead(score) OVER o AS c, list_sort(list(score) OVER (PARTITION BY image_id)) AS l FROM sc WINDOW o AS (PARTITION BY image_id ORDER BY lag)),
pk AS (SELECT *, l[floor(0.5e0 * (len(l) - 1) + 0.5e0)::INT + 1] AS mid FROM w WHERE score > a AND score >= c AND score > l[floor(0.5e0 * (len(l) - 1) + 0.5e0)::INT + 1]),
f AS (SELECT image_id, arg_min((lag, a, score, c), lag) AS p FROM pk WHERE score >= 0.5e0 * (SELECT max(score) FROM pk q WHERE q.image_id = pk.image_id) GROUP BY image_id),
st AS (SELECT image_id, greatest(0e0, least(1e0, (max(score) - max(mid)) / (abs(max(score)) + 1e-6))) AS strength FROM pk GROUP BY image_id),
g AS (SELECT image_id, p[1] AS lag, p[2] AS a, p[3] AS b, p[4] AS c, strength FROM f JOIN st USING (image_id))
SELECT i.image_id, coalesce(round(strength, 6), 0e0) AS strength, coalesce(round(lag + CASE WHEN a - 2 * b + c <> 0 AND abs(0.5e0 * (a - c) / (a - 2 * b + c)) < 1 THEN 0.5e0 * (a - c) / (a - 2 * b + c) ELSE 0e0 END, 6), 0e0) AS pitch FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN g USING (image_id)""",
    "rim_colour": f"""WITH {RGB}, ce AS (SELECT DISTINCT image_id, k::INT AS marker_id, 8 + 16 * (k // 2) AS cy, 8 + 16 * (k % 2) AS cx FROM px, range(0, 4) t(k))
SELECT ce.image_id, marker_id, coalesce(round(avg(r), 6), 0e0) AS r, coalesce(round(avg(g), 6), 0e0) AS g, coalesce(round(avg(b), 6), 0e0) AS b FROM ce LEFT JOIN px ON px.image_id = ce.image_id
AND (px.y - cy) * (px.y - cy) + (px.x - cx) * (px.x - cx) BETWEEN pow(16 * 0.18e0, 2) AND pow(16 * 0.26e0, 2) GROUP BY ALL""",
    "component_labels": f"{_reach('v <= 120', True)} SELECT image_id, y, x, label::BIGINT AS label FROM lab",
    "component_measures": f"""{_reach('v <= 120', True)} SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY label))::INT AS component, area, min_x, max_x, min_y, max_y, cx, cy, mu20, mu02, mu11 FROM (
SELECT image_id, label, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, round(avg(x) + 1e-9, 6) AS cx, round(avg(y) + 1e-9, 6) AS cy, round(var_pop(x) + 1e-9, 6) AS mu20, round(var_pop(y) + 1e-9, 6) AS mu02, round(covar_pop(x, y) + 1e-9, 6) AS mu11 FROM lab GROUP BY ALL)""",
    "hole_counts": f"""{_reach('v > 140', False)}, r AS (SELECT image_id, label, max((y = 0 OR x = 0 OR y = 7 OR x = 7)::INT) AS edge FROM lab GROUP BY ALL)
SELECT i.image_id, count(label) FILTER (edge = 0) AS holes FROM (SELECT DISTINCT image_id FROM px) i LEFT JOIN r USING (image_id) GROUP BY ALL""",
    "chamfer_distances": f"WITH {CHAMFER} SELECT image_id, digit::INT AS digit, round(distance, 6) AS distance FROM dist",
}
