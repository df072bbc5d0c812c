"""Tiles of markers, their centres and readings, and radial symmetry, with SQL for the same rows where there is one.

Images are mosaics of vectors; each holds one marker per vector, whose radius depends on the vector.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphtally import settings as S
from glyphtally.operators import crops as C, raster as R, symmetry as Y
from glyphtally.operators.lineage import cut
from glyphtally.plans import raster_queries as RQ


def _markers(spark, sf_dir):
    """A marker in the middle of each vector of a mosaic."""
    v = RQ._vectors(spark, sf_dir)
    at = lambda k: (8 * k + 4).cast("double")
    return v.select(
        F.floor(F.col("vec_id") / 16).alias("image_id"), F.col("vec_id").alias("id"), at(F.col("vec_id") % 4).alias("x"), at(F.floor(F.col("vec_id") % 16 / 4)).alias("y"),
        (2.0 + F.col("vec_id") % 3).alias("radius"))


def marker_tiles(spark, sf_dir):
    """The square around every marker, edges repeated; places without a vector have no pixels."""
    return C.tiles(RQ.mosaic(spark, sf_dir), _markers(spark, sf_dir)).where("v IS NOT NULL")


def spoke_radii(spark, sf_dir):
    """Radii of light centres by spokes, each mosaic taken as a tile with a ring of its own size."""
    px = RQ.mosaic(spark, sf_dir)
    rings = px.select("image_id").distinct().withColumn("ring", 9.03 + F.col("image_id") % 7)
    out = C.centre_radius(px, rings)
    return out.select("image_id", F.round("radius", 6).alias("radius"), "met")


def marker_readings(spark, sf_dir):
    """Every mosaic read as one marker: tile, centre, digits by several discs, two variants, vote."""
    px = RQ.mosaic(spark, sf_dir)
    middle = px.select("image_id").distinct().select("image_id", F.col("image_id").alias("id"), F.lit(16.0).alias("x"), F.lit(16.0).alias("y"), F.lit(6.0).alias("radius"))
    out = C.read_markers(px, middle, size=48)
    return out.select("id", "value", F.round("confidence", 5).alias("confidence"), "agreeing", F.round("radius", 6).alias("radius"), "met")


def voted_readings(spark, sf_dir):
    """Three readings of every vector, some of them without a value, put to the vote."""
    v = RQ._vectors(spark, sf_dir).withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    level = lambda k: F.abs(F.get("embedding", F.col("turn") + k).cast("double"))
    value = F.floor(level(0) * 1000).cast("int") % 4
    attempts = v.select(F.col("vec_id").alias("image_id"), "turn", F.when(value > 0, value).alias("value"), F.round(level(8) * 4, 3).alias("confidence"))
    out = C.voted(attempts)
    return out.withColumn("confidence", F.round("confidence", 6))


def symmetry_maps(spark, sf_dir):
    """Votes of edges for light centres at three distances, two of them blurred alike."""
    out = Y.radial_symmetry(RQ.mosaic(spark, sf_dir), [2, 3, 5], 60.0, 2.0, 200.0)
    return out.withColumn("v", F.round("v", 4))


def symmetry_peaks(spark, sf_dir):
    """Peaks of the maps above their image's 0.7 percentile, each with a disc of its own."""
    maps = cut(Y.radial_symmetry(RQ.mosaic(spark, sf_dir), [2, 3, 5], 60.0, 2.0, 200.0))
    limits = Y.map_percentile(maps, 0.7).withColumnRenamed("value", "limit")
    return Y.peaks(maps.join(limits, "image_id"), 5.0, F.col("limit")).withColumn("score", F.round("score", 4))


def magnitude_percentiles(spark, sf_dir):
    """Levels below which 90 % of an image's gradients lie."""
    maps = R.sobel(RQ.mosaic(spark, sf_dir)).select("image_id", "y", "x", F.round("mag", 6).alias("v"))
    return Y.map_percentile(maps, 0.9).withColumn("value", F.round("value", 6))


QUERIES = {f.__name__: f for f in (marker_tiles, spoke_radii, marker_readings, voted_readings, symmetry_maps, symmetry_peaks, magnitude_percentiles)}

_DIRECTIONS = ", ".join(f"({k}, {c!r}::DOUBLE, {s!r}::DOUBLE)" for k, (c, s) in enumerate(C.DIRECTIONS))

MAGNITUDES = f"""{RQ.MOSAIC}, gn AS (SELECT p.image_id, p.y, p.x, count(*) AS k, sum(q.v * (q.x - p.x) * CASE WHEN q.y = p.y THEN 2 ELSE 1 END) AS gx, sum(q.v * (q.y - p.y) * CASE WHEN q.x = p.x THEN 2 ELSE 1 END) AS gy
  FROM px p JOIN (SELECT image_id, v, y, x, y + dy AS cy, x + dx AS cx FROM px, range(-1, 2) a(dy), range(-1, 2) b(dx)) q ON q.image_id = p.image_id AND q.cy = p.y AND q.cx = p.x GROUP BY ALL),
gr AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN k = 9 THEN sqrt((gx * gx + gy * gy)::DOUBLE) ELSE 0e0 END AS mag, gx::DOUBLE AS gx, gy::DOUBLE AS gy FROM gn)"""


def _blur_map(src: str, out: str, radius: int) -> str:
    """CTEs that blur maps once along rows and columns, edges repeated."""
    step = lambda name, source, at, other: f"""{name} AS MATERIALIZED (SELECT t.image_id, t.{other}, t.{at}, sum(s.v) / {2 * radius + 1} AS v FROM (SELECT image_id, y, x, greatest(0, least(last, {at} + d)) AS at FROM (SELECT *, max({at}) OVER (PARTITION BY image_id) AS last FROM {source}), range({-radius}, {radius + 1}) r(d)) t
  JOIN {source} s ON s.image_id = t.image_id AND s.{other} = t.{other} AND s.{at} = t.at GROUP BY ALL)"""  # noqa: E731
    return step(f"{out}_x", src, "x", "y") + ",\n" + step(out, f"{out}_x", "y", "x")


def _map(radius: int, blur: int) -> str:
    n = f"m{radius}"
    return f"""{n}_v AS (SELECT image_id, trunc(y + gy / mag * {radius} + 0.5e0)::INT AS y, trunc(x + gx / mag * {radius} + 0.5e0)::INT AS x, count(*) AS n, sum(least(mag, 200e0)) AS m FROM gr WHERE mag >= 60 GROUP BY ALL),
{n}_f AS MATERIALIZED (SELECT px.image_id, px.y, px.x, coalesce(pow(least(n, 9.9e0) / 9.9e0, 2) * m / 9.9e0, 0e0) AS v FROM px LEFT JOIN {n}_v USING (image_id, y, x)),
{_blur_map(f'{n}_f', f'{n}_1', blur)},
{_blur_map(f'{n}_1', n, blur)}"""


ORACLES = {
    "marker_tiles": f"""WITH {RQ.MOSAIC}, mk AS (SELECT vec_id AS id, vec_id // 16 AS image_id, 8 * (vec_id % 4) + 4 AS cx, 8 * ((vec_id % 16) // 4) + 4 AS cy, greatest(8, floor((2 + vec_id % 3) * 2 * {S.TILE_FACTOR}e0 + 0.5e0))::INT AS side FROM embeddings),
sq AS (SELECT mk.*, t.y::INT AS y, u.x::INT AS x FROM mk, range(0, 32) t(y), range(0, 32) u(x) WHERE t.y < side AND u.x < side),
mx AS (SELECT image_id, max(y) AS h, max(x) AS w FROM px GROUP BY image_id)
SELECT id AS image_id, sq.y, sq.x, v FROM sq JOIN mx USING (image_id) JOIN px ON px.image_id = sq.image_id AND px.y = greatest(0, least(h, floor(cy - side / 2e0 + 0.5e0)::INT + sq.y)) AND px.x = greatest(0, least(w, floor(cx - side / 2e0 + 0.5e0)::INT + sq.x))""",
    "spoke_radii": f"""WITH {RQ.MOSAIC}, di(k, c, s) AS (VALUES {_DIRECTIONS}), mx AS (SELECT image_id, max(x) + 1 AS n, 9.03e0 + image_id % 7 AS ring FROM px GROUP BY image_id),
st AS (SELECT image_id, n, ring, 0e0 AS r, true AS light FROM mx UNION ALL SELECT image_id, n, ring, ring * 0.15e0 + j, true FROM mx, range(0, 100) t(j) WHERE j <= ring * 0.25e0
  UNION ALL SELECT image_id, n, ring, ring * 0.4e0 + j, false FROM mx, range(0, 100) t(j) WHERE j <= ring * 1.2e0),
se AS (SELECT st.image_id, ring, k, r, light, v FROM st, di, px WHERE px.image_id = st.image_id AND px.y = greatest(0, least(n - 1, floor(n / 2e0 + s * r + 0.5e0)::INT)) AND px.x = greatest(0, least(n - 1, floor(n / 2e0 + c * r + 0.5e0)::INT))),
rf AS (SELECT image_id, k, max(v) AS reference FROM se WHERE light GROUP BY ALL),
hi AS (SELECT image_id, k, min(r) AS hit FROM se JOIN rf USING (image_id, k) WHERE NOT light AND v < reference - 45 GROUP BY ALL),
md AS (SELECT image_id, list_sort(list(hit)) AS h FROM hi GROUP BY image_id),
ag AS (SELECT image_id, h, list_filter(h, lambda r: abs(r - h[floor(0.5e0 * (len(h) - 1) + 0.5e0)::INT + 1]) <= 0.2e0 * h[floor(0.5e0 * (len(h) - 1) + 0.5e0)::INT + 1]) AS a FROM md)
SELECT image_id, CASE WHEN len(h) >= 12 AND len(a) >= 12 THEN len(a) ELSE 0 END::INT AS met,
round(CASE WHEN len(h) >= 12 AND len(a) >= 12 THEN greatest(ring * 0.4e0, least(ring * 0.85e0, 0.9e0 * a[floor(0.5e0 * (len(a) - 1) + 0.5e0)::INT + 1])) ELSE ring * 0.62e0 END, 6) AS radius FROM mx LEFT JOIN ag USING (image_id)""",
    "voted_readings": """WITH rd AS (SELECT vec_id AS image_id, t::INT AS turn, nullif(floor(abs(embedding[t + 1]::DOUBLE) * 1000)::INT % 4, 0) AS value, round(abs(embedding[t + 9]::DOUBLE) * 4, 3) AS confidence FROM embeddings, range(0, 3) r(t)),
be AS (SELECT image_id, arg_max((confidence, value), (confidence, -turn)) FILTER (value IS NOT NULL AND confidence > 0) AS b FROM rd GROUP BY image_id),
ag AS (SELECT image_id, b[1] AS confidence, b[2] AS value, count(rd.value) FILTER (rd.value = b[2]) AS n FROM be JOIN rd USING (image_id) GROUP BY ALL)
SELECT image_id, value::INT AS value, round(least(1e0, coalesce(confidence, 0e0) * CASE WHEN n >= 2 THEN 1.15e0 ELSE 1e0 END), 6) AS confidence, n::INT AS agreeing FROM ag""",
    "symmetry_maps": f"""WITH {MAGNITUDES}, {_map(2, 1)}, {_map(3, 1)}, {_map(5, 2)}
SELECT image_id, y, x, round((m2.v + m3.v + m5.v) / 3, 4) AS v FROM m2 JOIN m3 USING (image_id, y, x) JOIN m5 USING (image_id, y, x)""",
    "magnitude_percentiles": f"""WITH {MAGNITUDES}, v AS (SELECT image_id, round(mag, 6) AS v FROM gr), tp AS (SELECT image_id, max(v) AS top, count(*) AS n FROM v GROUP BY ALL),
b AS (SELECT image_id, top, n, trunc(v / top * 2047)::INT AS bin, count(*) AS k FROM v JOIN tp USING (image_id) WHERE top > 0 GROUP BY ALL),
c AS (SELECT *, sum(k) OVER (PARTITION BY image_id ORDER BY bin) AS up FROM b)
SELECT tp.image_id, coalesce(round(min(bin) / 2047e0 * tp.top, 6), 0e0) AS value FROM tp LEFT JOIN c ON c.image_id = tp.image_id AND up >= c.n * 0.9e0 GROUP BY tp.image_id, tp.top""",
}
