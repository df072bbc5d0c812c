"""Finding, cutting out and resampling digits over images made of the embedding table, with SQL for the same rows.

A single image is one vector as 8 x 8 gray levels; a mosaic puts 4 x 4 vectors of consecutive ids side by side. Single images are taken to have a pitch of 12.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphtally.operators import detection as D, glyphs as G, graph, raster as R
from glyphtally.plans import raster_queries as RQ

PITCH, CONTRAST = 12.0, 40.0


def digit_candidates(spark, sf_dir):
    c = D.candidates(RQ.single(spark, sf_dir), PITCH)
    return c.select("image_id", F.col("id.number").alias("component"), "area", "min_x", "max_x", "min_y", "max_y", F.round(F.col("x") + 1e-9, 6).alias("x"), F.round(F.col("y") + 1e-9, 6).alias("y"), F.round("glyph_mean", 6).alias("glyph_mean"))


def faced_candidates(spark, sf_dir):
    px = RQ.single(spark, sf_dir)
    out = D.face_test(px, D.candidates(px, PITCH), CONTRAST)
    return out.select("image_id", F.col("id.number").alias("component"), *[F.round(c, 5).alias(c) for c in ("face_mean", "face_contrast", "roughness", "score")])


def detected_digits(spark, sf_dir):
    """The whole chain, both polarities where there are enough; the greedy steps have no SQL and are tested against brute force."""
    out = D.detect_both(RQ.mosaic(spark, sf_dir), PITCH, CONTRAST, least=4)
    return out.select("image_id", F.col("id.number").alias("number"), "inverted", *[F.round(c, 5).alias(c) for c in ("x", "y", "score")])


def extracted_glyphs(spark, sf_dir):
    """The digits of the detections as rasters; tested against brute force."""
    px = RQ.mosaic(spark, sf_dir)
    out = G.extract(px, D.detect(px, PITCH, CONTRAST))
    return out.select("id.image_id", F.col("id.number").alias("number"), F.round("aspect", 6).alias("aspect"), F.round("density", 6).alias("density"), F.size("glyph").alias("cells"))


def isolated_digits(spark, sf_dir):
    return G.isolate(RQ.single(spark, sf_dir).withColumn("threshold", F.lit(120)))


def _fitted(spark, sf_dir):
    return G.fit(RQ.single(spark, sf_dir).where("v <= 110").select("image_id", "y", "x"), 16)


def fitted_glyphs(spark, sf_dir):
    return _fitted(spark, sf_dir)[0].withColumn("v", F.round("v", 9))


def glyph_shapes(spark, sf_dir):
    return _fitted(spark, sf_dir)[1].select("image_id", F.round("aspect", 9).alias("aspect"), F.round("density", 9).alias("density"))


def softened_glyphs(spark, sf_dir):
    return G.soften(RQ.single(spark, sf_dir).withColumn("v", F.col("v") / 255)).withColumn("v", F.round("v", 9))


def painted_mask(spark, sf_dir):
    return RQ.single(spark, sf_dir).withColumn("v", F.round(G.shade(F.col("v") / 255), 6))


def component_ellipses(spark, sf_dir):
    m = graph.ellipse(graph.measures(graph.components(RQ.single(spark, sf_dir).where("v <= 120"))))
    return m.select("image_id", "component", *[F.round(c, 5).alias(c) for c in ("major", "minor", "circularity")])


def hole_owners(spark, sf_dir):
    """Holes and their area per component, in the order of the components."""
    return graph.attributed_holes(RQ.single(spark, sf_dir), F.col("v") <= 140)


def downscaled(spark, sf_dir):
    return R.downscale_by(RQ.mosaic(spark, sf_dir), 0.4)


def upscaled(spark, sf_dir):
    return R.upscale(RQ.single(spark, sf_dir), 19, 13)


def resampled(spark, sf_dir):
    """Single images enlarged and mosaics reduced to 12 x 12; a mosaic is 32 wide even where vectors are missing."""
    small, large = RQ.single(spark, sf_dir), RQ.mosaic(spark, sf_dir).withColumn("image_id", -F.col("image_id") - 1)
    edges = lambda px, n: px.select("image_id").distinct().select("image_id", F.lit(n).alias("h"), F.lit(n).alias("w"))
    return R.resample(small.unionByName(large), 12, edges(small, 8).unionByName(edges(large, 32)))


def bilinear_reads(spark, sf_dir):
    at = RQ._vectors(spark, sf_dir).select(F.col("vec_id").alias("image_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("id"))
    at = at.withColumn("y", F.col("id") * 3.75 - 0.5 + F.col("image_id") % 4 / 4).withColumn("x", 8.5 - F.col("id") * 3.25)
    return R.bilinear(RQ.single(spark, sf_dir), at).withColumn("v", F.round("v", 6))


def image_fingerprints(spark, sf_dir):
    return R.fingerprint(RQ.rgb(spark, sf_dir))


def disc_thresholds(spark, sf_dir):
    px = RQ.single(spark, sf_dir)
    centres = px.select("image_id").distinct().withColumn("cy", F.lit(4.0)).withColumn("cx", F.lit(4.0)).withColumn("radius", F.when(F.col("image_id") % 3 == 0, 2.0).otherwise(3.0))
    return R.disc_otsu(px, centres)


QUERIES = {f.__name__: f for f in (
    digit_candidates, faced_candidates, detected_digits, extracted_glyphs, isolated_digits, fitted_glyphs, glyph_shapes, softened_glyphs, painted_mask, component_ellipses, hole_owners,
    downscaled, upscaled, resampled, bilinear_reads, image_fingerprints, disc_thresholds)}


def _means(radius: int, out: str) -> str:
    return f"""{out} AS (SELECT p.image_id, p.y, p.x, avg(q.v) AS mean FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.y - p.y) <= {radius} AND abs(q.x - p.x) <= {radius} GROUP BY ALL)"""


def _reach(ink: str, diagonal: bool, tag: str = "") -> str:
    """CTEs that label the cells of ``ink`` (image_id, y, x) as lab (image_id, y, x, label)."""
    near = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1" if diagonal else "abs(a.y - b.y) + abs(a.x - b.x) <= 1"
    return f"""sp{tag} AS (SELECT image_id, y, x, y * 1048576 + x AS spot FROM {ink}), nb{tag} AS (SELECT a.image_id, a.spot AS s, b.spot AS t FROM sp{tag} a JOIN sp{tag} b ON a.image_id = b.image_id AND {near}),
re{tag} AS (SELECT image_id, s, t FROM nb{tag} UNION SELECT r.image_id, r.s, nb{tag}.t FROM re{tag} r JOIN nb{tag} ON r.image_id = nb{tag}.image_id AND r.t = nb{tag}.s),
lab{tag} AS (SELECT i.image_id, y, x, min(t) AS label FROM re{tag} r JOIN sp{tag} i ON i.image_id = r.image_id AND i.spot = r.s GROUP BY i.image_id, y, x)"""


CANDIDATES = f"""{RQ.SINGLE}, {RQ._moments(3)}, ink AS (SELECT image_id, y, x, v FROM c WHERE v <= mean * (1 + 0.28e0 * (std / 128e0 - 1))), {_reach('ink', True)},
co AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY label) AS component, * EXCLUDE (image_id, label) FROM (SELECT image_id, label, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, avg(x) AS x, avg(y) AS y, avg(v) AS glyph_mean FROM lab JOIN ink USING (image_id, y, x) GROUP BY ALL)),
ca AS (SELECT * FROM co WHERE max_y - min_y + 1 BETWEEN 0.12e0 * {PITCH} AND 0.8e0 * {PITCH} AND max_x - min_x + 1 <= 0.8e0 * {PITCH} AND max_x - min_x + 1 <= (max_y - min_y + 1) * 1.6e0 AND area >= (max_x - min_x + 1) * (max_y - min_y + 1) * 0.12e0)"""
FITTED = f"""{RQ.SINGLE}, ink AS (SELECT image_id, y, x FROM px WHERE v <= 110),
bx AS (SELECT image_id, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS iw, max(y) - min(y) + 1 AS ih, 12e0 / greatest(max(x) - min(x) + 1, max(y) - min(y) + 1) AS sc FROM ink GROUP BY image_id HAVING count(*) >= 4)"""


def _stretch(src: str, out: str, along: str, other: str, n: int, target: int) -> str:
    p = [f"(SELECT v FROM {src} q WHERE q.image_id = s.image_id AND q.{other} = s.{other} AND q.{along} = greatest(0, least({n} - 1, s.f + {k})))::DOUBLE" for k in (-1, 0, 1, 2)]
    return f"""{out}_s AS (SELECT image_id, {other}, t, (t + 0.5e0) * ({n}::DOUBLE / {target}) - 0.5e0 AS w, floor((t + 0.5e0) * ({n}::DOUBLE / {target}) - 0.5e0)::INT AS f FROM (SELECT DISTINCT image_id, {other} FROM {src}), range(0, {target}) r(t)),
{out}_p AS (SELECT image_id, {other}, t, w - f AS u, {p[0]} AS p0, {p[1]} AS p1, {p[2]} AS p2, {p[3]} AS p3 FROM {out}_s s),
{out} AS (SELECT image_id, {other}, t::INT AS {along}, (((-0.5e0*p0+1.5e0*p1-1.5e0*p2+0.5e0*p3) * u + (p0-2.5e0*p1+2*p2-0.5e0*p3)) * u + (-0.5e0*p0+0.5e0*p2)) * u + p1 AS v FROM {out}_p)"""


def _shrunk(src: str, n: int, d: int) -> str:
    lines = f"(SELECT t, floor(t * ({n}::DOUBLE / {d})) AS lo, least({n}, greatest(floor(t * ({n}::DOUBLE / {d})) + 1, floor((t + 1) * ({n}::DOUBLE / {d})))) AS hi FROM range(0, {d}) r(t))"
    return f"SELECT image_id, a.t::INT AS y, b.t::INT AS x, {RQ.CLAMP.format('avg(v)')} AS v FROM {src} JOIN {lines} a ON y >= a.lo AND y < a.hi JOIN {lines} b ON x >= b.lo AND x < b.hi GROUP BY ALL"


ORACLES = {
    "digit_candidates": f"WITH RECURSIVE {CANDIDATES} SELECT image_id, component::INT AS component, area, min_x, max_x, min_y, max_y, round(x + 1e-9, 6) AS x, round(y + 1e-9, 6) AS y, round(glyph_mean, 6) AS glyph_mean FROM ca",
    "faced_candidates": f"""WITH RECURSIVE {CANDIDATES}, {_means(3, 'm3')}, {_means(5, 'm5')},
tst AS (SELECT ca.*, m3.mean AS rough, m5.mean AS around, (m3.mean + glyph_mean) / 2 AS split FROM ca JOIN m3 ON m3.image_id = ca.image_id AND m3.y = floor(ca.y + 0.5e0) AND m3.x = floor(ca.x + 0.5e0) JOIN m5 ON m5.image_id = ca.image_id AND m5.y = m3.y AND m5.x = m3.x),
fa AS (SELECT tst.image_id, component, count(px.v) AS n, avg(px.v) AS mean, stddev_pop(px.v) AS std FROM tst LEFT JOIN px ON px.image_id = tst.image_id AND pow(px.x - tst.x, 2) + pow(px.y - tst.y, 2) <= 9 AND px.v >= split GROUP BY ALL),
fm AS (SELECT tst.*, CASE WHEN n >= 8 THEN fa.mean ELSE rough END AS face_mean, CASE WHEN n >= 8 AND fa.mean > 0 THEN std / fa.mean ELSE 1e0 END AS roughness FROM tst JOIN fa USING (image_id, component))
SELECT image_id, component::INT AS component, round(face_mean, 5) AS face_mean, round(face_mean - around, 5) AS face_contrast, round(roughness, 5) AS roughness, round(face_mean - glyph_mean + 0.5e0 * greatest(0e0, face_mean - around), 5) AS score FROM fm WHERE face_mean - glyph_mean >= {CONTRAST} AND face_mean - around >= -6""",
    "isolated_digits": f"""WITH RECURSIVE {RQ.SINGLE}, ink AS (SELECT image_id, y, x FROM px WHERE v <= 120), {_reach('ink', False)},
pc AS (SELECT image_id, label, count(*) AS area, avg(x) AS cx, avg(y) AS cy, max((x IN (0, 7) OR y IN (0, 7))::INT) AS edge FROM lab GROUP BY ALL),
bs AS (SELECT *, area - 0.5e0 * (pow(cx - 3.5e0, 2) + pow(cy - 3.5e0, 2)) - CASE WHEN edge = 1 THEN 0.75e0 * area ELSE 0e0 END AS score FROM pc WHERE area >= 4 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label) = 1),
kp AS (SELECT pc.image_id, pc.label FROM pc JOIN bs ON bs.image_id = pc.image_id WHERE pc.label = bs.label OR (pc.edge = 0 AND pc.area <= 0.6e0 * bs.area AND sqrt(pow(pc.cx - bs.cx, 2) + pow(pc.cy - bs.cy, 2)) <= 0.35e0 * 8))
SELECT image_id, y, x FROM lab JOIN kp USING (image_id, label)""",
    "fitted_glyphs": f"""WITH {FITTED}, ln AS (SELECT bx.*, t, (t - (2 + (12 - ih * sc) / 2)) * (1 / sc) AS yb, (t - (2 + (12 - iw * sc) / 2)) * (1 / sc) AS xb FROM bx, range(0, 16) r(t)),
yl AS (SELECT image_id, t, y0 + greatest(0, floor(yb)) AS lo, y0 + least(ih - 1, ceil(yb + 1 / sc) - 1) AS hi FROM ln WHERE yb + 1 / sc > 0 AND yb < ih), xl AS (SELECT image_id, t, x0 + greatest(0, floor(xb)) AS lo, x0 + least(iw - 1, ceil(xb + 1 / sc) - 1) AS hi FROM ln WHERE xb + 1 / sc > 0 AND xb < iw),
cn AS (SELECT yl.image_id, yl.t AS y, xl.t AS x, count(ink.x) / ((yl.hi - yl.lo + 1) * (xl.hi - xl.lo + 1)) AS v FROM yl JOIN xl USING (image_id) LEFT JOIN ink ON ink.image_id = yl.image_id AND ink.y BETWEEN yl.lo AND yl.hi AND ink.x BETWEEN xl.lo AND xl.hi GROUP BY yl.image_id, yl.t, xl.t, yl.lo, yl.hi, xl.lo, xl.hi)
SELECT bx.image_id, a.t::INT AS y, b.t::INT AS x, round(coalesce(v, 0e0), 9) AS v FROM bx, range(0, 16) a(t), range(0, 16) b(t) LEFT JOIN cn ON cn.image_id = bx.image_id AND cn.y = a.t AND cn.x = b.t""",
    "glyph_shapes": f"WITH {FITTED} SELECT image_id, round(iw / ih::DOUBLE, 9) AS aspect, round(n / (iw * ih)::DOUBLE, 9) AS density FROM bx",
    "softened_glyphs": f"""WITH {RQ.SINGLE}, f0 AS (SELECT image_id, y, x, v / 255e0 AS v FROM px), """ + ", ".join(
        f"f{k + 1} AS (SELECT image_id, y, x, (coalesce(lag(v) OVER w, v) + 2 * v + coalesce(lead(v) OVER w, v)) / 4 AS v FROM f{k} WINDOW w AS (PARTITION BY image_id, {a} ORDER BY {b}))" for k, (a, b) in enumerate([("y", "x"), ("x", "y")] * 2)) + " SELECT image_id, y, x, round(v, 9) AS v FROM f4",
    "painted_mask": f"WITH {RQ.SINGLE} SELECT image_id, y, x, round(245 - v / 255e0 * 225, 6) AS v FROM px",
    "component_ellipses": f"""{RQ._reach('v <= 120', True)}, m AS (SELECT image_id, label, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM lab GROUP BY ALL),
e AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY label) AS component, sqrt(greatest(1e-9, 2 * (a + b + sqrt(pow(a - b, 2) + 4 * c * c)))) AS major, sqrt(greatest(1e-9, 2 * (a + b - sqrt(pow(a - b, 2) + 4 * c * c)))) AS minor FROM m)
SELECT image_id, component::INT AS component, round(major, 5) AS major, round(minor, 5) AS minor, round(minor / major, 5) AS circularity FROM e""",
    "hole_owners": f"""WITH RECURSIVE {RQ.SINGLE}, ink AS (SELECT image_id, y, x FROM px WHERE v <= 140), gap AS (SELECT image_id, y, x FROM px WHERE v > 140), {_reach('ink', True, 'i')}, {_reach('gap', False, 'g')},
inn AS (SELECT image_id, label FROM labg GROUP BY ALL HAVING max((y IN (0, 7) OR x IN (0, 7))::INT) = 0), cell AS (SELECT labg.* FROM labg JOIN inn USING (image_id, label)),
ow AS (SELECT c.image_id, c.label AS hole, arg_min(i.label, (c.y * 8 + c.x, CASE WHEN i.x < c.x THEN 0 WHEN i.x > c.x THEN 1 WHEN i.y < c.y THEN 2 ELSE 3 END)) AS label FROM cell c JOIN labi i ON i.image_id = c.image_id AND abs(i.y - c.y) + abs(i.x - c.x) = 1 GROUP BY ALL),
ar AS (SELECT image_id, label AS hole, count(*) AS area FROM cell GROUP BY ALL), hs AS (SELECT image_id, label, count(*) AS holes, sum(area)::BIGINT AS hole_area FROM ow JOIN ar USING (image_id, hole) GROUP BY ALL)
SELECT l.image_id, l.label::BIGINT AS label, coalesce(holes, 0) AS holes, coalesce(hole_area, 0) AS hole_area FROM (SELECT DISTINCT image_id, label FROM labi) l LEFT JOIN hs USING (image_id, label)""",
    "downscaled": f"""WITH {RQ.MOSAIC}, sz AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w, greatest(1, floor((max(y) + 1) * 0.4e0 + 0.5e0)) AS dh, greatest(1, floor((max(x) + 1) * 0.4e0 + 0.5e0)) AS dw FROM px GROUP BY image_id),
ly AS (SELECT image_id, t, floor(t * (h / dh)) AS lo, least(h, greatest(floor(t * (h / dh)) + 1, floor((t + 1) * (h / dh)))) AS hi FROM sz, range(0, 32) r(t) WHERE t < dh), lx AS (SELECT image_id, t, floor(t * (w / dw)) AS lo, least(w, greatest(floor(t * (w / dw)) + 1, floor((t + 1) * (w / dw)))) AS hi FROM sz, range(0, 32) r(t) WHERE t < dw)
SELECT px.image_id, ly.t::INT AS y, lx.t::INT AS x, {RQ.CLAMP.format('avg(v)')} AS v FROM px JOIN ly ON ly.image_id = px.image_id AND y >= ly.lo AND y < ly.hi JOIN lx ON lx.image_id = px.image_id AND x >= lx.lo AND x < lx.hi GROUP BY ALL""",
    "upscaled": f"WITH {RQ.SINGLE}, {_stretch('px', 'ac', 'x', 'y', 8, 13)}, {_stretch('ac', 'dn', 'y', 'x', 8, 19)} SELECT image_id, y, x, {RQ.CLAMP.format('v')} AS v FROM dn",
    "resampled": f"""WITH {RQ.SINGLE}, {RQ._mosaic_sql(4, 'mo')}, {_stretch('px', 'ac', 'x', 'y', 8, 12)}, {_stretch('ac', 'dn', 'y', 'x', 8, 12)} SELECT image_id, y, x, {RQ.CLAMP.format('v')} AS v FROM dn
UNION ALL SELECT -image_id - 1, y, x, v FROM ({_shrunk('mo', 32, 12)})""",
    "bilinear_reads": f"""WITH {RQ.SINGLE}, rd AS (SELECT vec_id AS image_id, k::INT AS id, k * 3.75e0 - 0.5e0 + (vec_id % 4) / 4e0 AS y, 8.5e0 - k * 3.25e0 AS x FROM embeddings, range(0, 3) t(k)),
tp AS (SELECT image_id, id, greatest(0, least(7, floor(y) + a)) AS y, greatest(0, least(7, floor(x) + b)) AS x, CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE WHEN b = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS w FROM rd, range(0, 2) p(a), range(0, 2) q(b))
SELECT image_id, id, round(sum(v * w), 6) AS v FROM tp JOIN px USING (image_id, y, x) GROUP BY ALL""",
    "image_fingerprints": f"""WITH {RQ.RGB}, f AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h, list((r + g * 256 + b * 65536)::BIGINT ORDER BY y, x) AS codes FROM px GROUP BY image_id)
SELECT image_id, w || 'x' || h || '-' || lower(to_base(list_reduce(codes, lambda h, v: (xor(h, v) * 16777619) % 4294967296, 2166136261::BIGINT), 36)) AS signature FROM f""",
    "disc_thresholds": f"""WITH {RQ.SINGLE.replace('px AS', 'al AS')}, px AS (SELECT * FROM al WHERE pow(x - 4, 2) + pow(y - 4, 2) <= CASE WHEN image_id % 3 = 0 THEN 4 ELSE 9 END), {RQ.OTSU}, n AS (SELECT image_id, count(*) AS k FROM px GROUP BY image_id)
SELECT image_id, CASE WHEN k > 16 THEN threshold ELSE 128 END::INT AS threshold FROM n JOIN th USING (image_id)""",
}
