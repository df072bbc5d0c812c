"""Glyph-vector and point queries over the embedding table, with SQL for the same rows.

Vectors are glyphs (negative components are no ink) and labels their numbers; the first two components, times 1000, are positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtally.functions.numeric import group_band, hole_penalty, match_band, polarity_rank
from glyphtally.operators import counting, graph, reading, spatial, vectors as V
from glyphtally.settings import CHAMFER_SCALE, NMS_DISTANCE, SNAP_DISTANCE
from glyphtally.sources.rasters import vector_pixels

PITCH = 100.0


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _by_label(spark, sf_dir):
    glyphs = V.glyphs(table(spark, sf_dir), keep=("label",))
    return glyphs, V.averages(glyphs, "label")


def _assigned(spark, sf_dir):
    glyphs, protos = _by_label(spark, sf_dir)
    return V.nearest(glyphs, protos.withColumnRenamed("label", "number"), "vec_id", "number", 9), glyphs, protos


def glyph_assign_counts(spark, sf_dir):
    """Vectors per nearest number, by confidence band, with the mean margin."""
    near, *_ = _assigned(spark, sf_dir)
    near = near.withColumn("band", group_band(F.col("number"), F.lit(1.0), F.col("margin"), F.lit(3)))
    return near.groupBy("number").agg(
        F.count("*").alias("markers"), F.count_if(F.col("band") == "high").alias("high"), F.count_if(F.col("band") == "medium").alias("medium"),
        F.count_if(F.col("band") == "review").alias("review"), F.round(F.avg("margin"), 6).alias("mean_margin"))


def glyph_distances(spark, sf_dir):
    glyphs, protos = _by_label(spark, sf_dir)
    return V.distances(glyphs, protos.withColumnRenamed("label", "number"), "vec_id", "number", 6)


def prototype_average(spark, sf_dir):
    protos = _by_label(spark, sf_dir)[1].select("label", F.posexplode("glyph").alias("pos", "p"))
    return protos.withColumn("p", F.round("p", 9))


def prototype_spread(spark, sf_dir):
    glyphs, protos = _by_label(spark, sf_dir)
    out = V.spread(glyphs, protos, "label")
    return out.select("label", "members", F.round("spread", 6).alias("spread"), F.round("sharpness", 6).alias("sharpness"))


def membership_margin(spark, sf_dir):
    near, *_ = _assigned(spark, sf_dir)
    return near.select("vec_id", "number", F.round("best", 6).alias("best"), F.round("margin", 6).alias("margin"))


def refined_clusters(spark, sf_dir):
    """Members after two rebuildings of the averages from the labels, none merged."""
    glyphs, _ = _by_label(spark, sf_dir)
    out = V.refine(glyphs.select("vec_id", "glyph"), glyphs.select("vec_id", F.col("label").alias("number")), "vec_id", "number", passes=2, limit=0.0, digits=9)
    return out.groupBy("number").agg(F.count("*").alias("members"), F.round(F.avg("best"), 6).alias("spread"))


def merged_prototypes(spark, sf_dir):
    """Averages of the labels merged where closer than a wide limit, in order."""
    _, protos = _by_label(spark, sf_dir)
    return V.merge_close(protos, "label", limit=0.2)


def surviving_clusters(spark, sf_dir):
    near, *_ = _assigned(spark, sf_dir)
    return V.survivors(near.select("vec_id", "number"), "number")


def example_matches(spark, sf_dir):
    """Every vector named by the three first vectors of each label as examples, by shape and colour."""
    df = table(spark, sf_dir)
    colour = [(128 + 256 * F.get("embedding", F.lit(k)).cast("double")).alias(c) for k, c in enumerate("rgb", 3)]
    first = df.groupBy("label").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, 3).alias("ids")).select(F.explode("ids").alias("vec_id"))
    coloured = V.glyphs(df.select("vec_id", "label", "embedding", *colour), keep=("label", "r", "g", "b"))
    examples = coloured.join(first, "vec_id").select(F.col("vec_id").alias("example_id"), F.col("label").alias("digit"), "glyph", *[F.col(c).alias(f"e{c}") for c in "rgb"])
    out = V.match_examples(coloured, examples, "vec_id")
    out = out.withColumn("band", match_band(F.col("digit"), F.round("best", 6), F.round("margin", 6)))
    return out.select("vec_id", "digit", F.round("best", 6).alias("distance"), F.round("margin", 6).alias("margin"), "band")


def purity_naming(spark, sf_dir):
    near, *_ = _assigned(spark, sf_dir)
    met = near.join(table(spark, sf_dir).select("vec_id", F.col("label").cast("int").alias("truth")), "vec_id")
    return counting.purity(met.select(F.col("number").alias("group"), "truth"), "group", "truth").withColumn("purity", F.round("purity", 6))


def _points(spark, sf_dir, at: int = 0):
    e = lambda k: F.get("embedding", F.lit(at + k)).cast("double") * 1000
    return table(spark, sf_dir).select("label", F.col("vec_id").alias("id"), e(0).alias("x"), e(1).alias("y"), F.get("embedding", F.lit(5)).cast("double").alias("score"))


def neighbour_spacing(spark, sf_dir):
    return spatial.neighbour_spacing(_points(spark, sf_dir), "label").withColumn("spacing", F.round("spacing", 6))


def snapped_taps(spark, sf_dir):
    """Each vector's second position snapped to the nearest first position of its label."""
    out = spatial.snap(_points(spark, sf_dir, 2), _points(spark, sf_dir), "label", SNAP_DISTANCE * PITCH)
    return out.select("label", "id", F.coalesce("hit", F.lit(-1)).alias("hit"), F.coalesce(F.round("distance", 6), F.lit(-1.0)).alias("distance"))


def second_polarity_only(spark, sf_dir):
    out = spatial.far_from(_points(spark, sf_dir, 2), _points(spark, sf_dir), "label", NMS_DISTANCE * PITCH)
    return out.select("label", "id")


def suppressed_neighbours(spark, sf_dir):
    """Greedy suppression within each label; odd ids count as inverted."""
    points = _points(spark, sf_dir).withColumn("rank", F.round(polarity_rank(F.col("score") + 1, F.col("id") % 2 == 1), 9))
    return spatial.suppress(points, "label", NMS_DISTANCE * PITCH).select("id", F.col("kept_as").eqNullSafe(F.col("id")).alias("kept"))


def hole_penalties(spark, sf_dir):
    """Similarity of each vector to its nearest number, by distance and by the holes of its image against those of the digit."""
    near, *_ = _assigned(spark, sf_dir)
    px = vector_pixels(table(spark, sf_dir)).repartition("image_id")
    own = graph.holes(px, F.col("v") <= 140).withColumnRenamed("image_id", "vec_id")
    digits = reading.template_holes(spark, 32).select(F.col("digit").alias("number"), F.col("holes").alias("expected"))
    met = near.join(own, "vec_id").join(F.broadcast(digits), "number")
    return met.select("vec_id", "holes", F.round(F.exp(-F.col("best") * 10 / CHAMFER_SCALE) * hole_penalty(F.col("holes"), F.col("expected")), 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (
    glyph_assign_counts, glyph_distances, prototype_average, prototype_spread, membership_margin, refined_clusters, merged_prototypes, surviving_clusters,
    example_matches, purity_naming, neighbour_spacing, snapped_taps, second_polarity_only, suppressed_neighbours, hole_penalties)}

CELLS = "cl AS (SELECT vec_id, label, (i - 1)::INT AS pos, greatest(embedding[i]::DOUBLE, 0e0) AS c FROM embeddings, range(1, 65) t(i))"
PROTO = f"{CELLS}, pt AS (SELECT label AS number, pos, avg(c) AS p FROM cl GROUP BY ALL)"


def _dist(cells: str, protos: str, out: str, key: str = "number", digits: int = 9) -> str:
    return f"{out} AS (SELECT vec_id, {key}, round(CASE WHEN sum(greatest(c, p)) > 0 THEN sum(abs(c - p)) / sum(greatest(c, p)) ELSE 1e0 END, {digits}) AS distance FROM {cells} JOIN {protos} USING (pos) GROUP BY ALL)"


def _near(dist: str, out: str, key: str = "number", row: str = "vec_id") -> str:
    return f"""{out}_r AS (SELECT *, row_number() OVER w AS k, lead(distance) OVER w AS second FROM {dist} WINDOW w AS (PARTITION BY {row} ORDER BY distance, {key})),
{out} AS (SELECT {row}, {key}, distance AS best, CASE WHEN second IS NULL OR second <= 0 THEN 1e0 ELSE greatest(0e0, least(1e0, (second - distance) / second)) END AS margin FROM {out}_r WHERE k = 1)"""


ASSIGNED = f"{PROTO}, {_dist('cl', 'pt', 'ds')}, {_near('ds', 'nr')}"


def _pts(name: str, at: int) -> str:
    return f"{name} AS (SELECT label, vec_id AS id, embedding[{at + 1}]::DOUBLE * 1000 AS x, embedding[{at + 2}]::DOUBLE * 1000 AS y, embedding[6]::DOUBLE AS score FROM embeddings)"


_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"

ORACLES = {
    "glyph_assign_counts": f"""WITH {ASSIGNED}, b AS (SELECT *, CASE WHEN margin < 0.08e0 THEN 'review' WHEN margin < 0.2e0 THEN 'medium' ELSE 'high' END AS band FROM nr)
SELECT number, count(*) AS markers, count(*) FILTER (band = 'high') AS high, count(*) FILTER (band = 'medium') AS medium, count(*) FILTER (band = 'review') AS review, round(avg(margin), 6) AS mean_margin FROM b GROUP BY number""",
    "glyph_distances": f"WITH {PROTO}, {_dist('cl', 'pt', 'ds', digits=6)} SELECT * FROM ds",
    "prototype_average": f"WITH {PROTO} SELECT number AS label, pos, round(p, 9) AS p FROM pt",
    "prototype_spread": f"""WITH {PROTO}, d AS (SELECT vec_id, label, CASE WHEN sum(greatest(c, p)) > 0 THEN sum(abs(c - p)) / sum(greatest(c, p)) ELSE 1e0 END AS d FROM cl JOIN pt ON pt.pos = cl.pos AND pt.number = cl.label GROUP BY ALL)
SELECT label, count(*) AS members, round(avg(d), 6) AS spread, round(greatest(0e0, least(1e0, 1 - 2.5e0 * avg(d))), 6) AS sharpness FROM d GROUP BY label""",
    "membership_margin": f"WITH {ASSIGNED} SELECT vec_id, number, round(best, 6) AS best, round(margin, 6) AS margin FROM nr",
    "refined_clusters": f"""WITH {ASSIGNED}, p2 AS (SELECT number, pos, avg(c) AS p FROM cl JOIN nr USING (vec_id) GROUP BY ALL), {_dist('cl', 'p2', 'd2')}, {_near('d2', 'n2')}
SELECT number, count(*) AS members, round(avg(best), 6) AS spread FROM n2 GROUP BY number""",
    "merged_prototypes": f"""WITH RECURSIVE {PROTO}, nb AS (SELECT a.number AS a, b.number AS b FROM pt a JOIN pt b USING (pos) WHERE a.number < b.number GROUP BY ALL
  HAVING CASE WHEN sum(greatest(a.p, b.p)) > 0 THEN sum(abs(a.p - b.p)) / sum(greatest(a.p, b.p)) ELSE 1e0 END < 0.2e0),
it AS (SELECT number, row_number() OVER (ORDER BY number) AS k FROM (SELECT DISTINCT number FROM pt)),
f AS (SELECT 0::BIGINT AS k, []::INT[] AS kept, NULL::INT AS id, NULL::INT AS kept_as UNION ALL
  SELECT it.k, CASE WHEN h.a IS NULL THEN list_append(f.kept, it.number) ELSE f.kept END, it.number, coalesce(h.a, it.number) FROM f JOIN it ON it.k = f.k + 1
  LEFT JOIN (SELECT * FROM nb) h ON h.b = it.number AND list_contains(f.kept, h.a) AND h.a = (SELECT min(n2.a) FROM nb n2 WHERE n2.b = it.number AND list_contains(f.kept, n2.a)))
SELECT id AS label, kept_as FROM f WHERE k > 0""",
    "surviving_clusters": f"WITH {ASSIGNED}, s AS (SELECT number, count(*) AS members FROM nr GROUP BY number HAVING count(*) >= 3) SELECT number, members, (row_number() OVER (ORDER BY members DESC, number) - 1)::INT AS rank FROM s",
    "example_matches": f"""WITH {CELLS}, co AS (SELECT vec_id, label, 128 + 256 * embedding[4]::DOUBLE AS r, 128 + 256 * embedding[5]::DOUBLE AS g, 128 + 256 * embedding[6]::DOUBLE AS b FROM embeddings),
ex AS (SELECT vec_id AS example_id, label AS digit, r AS er, g AS eg, b AS eb FROM co QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3),
ep AS (SELECT example_id, pos, c AS p FROM ex JOIN cl ON cl.vec_id = ex.example_id),
d AS (SELECT cl.vec_id, example_id, CASE WHEN sum(greatest(c, p)) > 0 THEN sum(abs(c - p)) / sum(greatest(c, p)) ELSE 1e0 END AS distance FROM cl JOIN ep USING (pos) GROUP BY ALL),
g AS (SELECT vec_id, digit, min(distance + 0.8e0 * sqrt((r - er) * (r - er) + (g - eg) * (g - eg) + (b - eb) * (b - eb)) / 60) AS distance FROM d JOIN ex USING (example_id) JOIN co USING (vec_id) GROUP BY ALL),
{_near('g', 'n', 'digit')}
SELECT vec_id, digit, round(best, 6) AS distance, round(margin, 6) AS margin, CASE WHEN round(best, 6) > 1.4e0 OR round(margin, 6) < 0.05e0 THEN 'review' WHEN round(best, 6) > 0.9e0 OR round(margin, 6) < 0.15e0 THEN 'medium' ELSE 'high' END AS band FROM n""",
    "purity_naming": f"""WITH {ASSIGNED}, c AS (SELECT number, label, count(*) AS n FROM nr JOIN embeddings USING (vec_id) GROUP BY ALL)
SELECT number AS "group", sum(n)::BIGINT AS members, arg_min(label, (-n, label)) AS majority, round(max(n) / sum(n)::DOUBLE, 6) AS purity, arg_min(label, (-n, label)) = number AS named_right FROM c GROUP BY number""",
    "neighbour_spacing": f"""WITH {_pts('p', 0)}, bx AS (SELECT label, greatest(8e0, sqrt(greatest(1e0, (max(x) - min(x)) * (max(y) - min(y))) / count(*)) * 2) AS s FROM p GROUP BY label),
nn AS (SELECT a.label, a.id, min({_D}) AS d FROM p a JOIN bx USING (label) JOIN p b ON b.label = a.label AND b.id <> a.id AND abs(floor(a.x / s) - floor(b.x / s)) <= 1 AND abs(floor(a.y / s) - floor(b.y / s)) <= 1 GROUP BY ALL),
l AS (SELECT label, list_sort(list(d)) AS l FROM nn GROUP BY label)
SELECT label, CASE WHEN len(l) >= 8 THEN round(l[floor(0.5e0 * (len(l) - 1) + 0.5e0)::INT + 1], 6) ELSE 0e0 END AS spacing FROM l""",
    "snapped_taps": f"""WITH {_pts('t', 2)}, {_pts('p', 0)}, m AS (SELECT a.id, b.id AS hit, {_D} AS d FROM t a JOIN p b ON a.label = b.label WHERE {_D} < 75),
f AS (SELECT id, arg_min(hit, (d, hit)) AS hit, min(d) AS d FROM m GROUP BY id) SELECT t.label, t.id, coalesce(f.hit, -1) AS hit, coalesce(round(f.d, 6), -1e0) AS distance FROM t LEFT JOIN f USING (id)""",
    "second_polarity_only": f"WITH {_pts('t', 2)}, {_pts('p', 0)} SELECT label, id FROM t a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.label = b.label AND {_D} < 0.55e0 * 100)",
    "suppressed_neighbours": f"""WITH RECURSIVE {_pts('p', 0)}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round((score + 1) * CASE WHEN id % 2 = 1 THEN 1 ELSE 1.25e0 END, 9) DESC, id) AS k FROM p),
f AS (SELECT label, 1::BIGINT AS k, [{{'x': x, 'y': y}}] AS kept, id, true AS stands FROM r WHERE k = 1 UNION ALL
  SELECT r.label, r.k, CASE WHEN len(list_filter(f.kept, lambda o: sqrt((o.x - r.x) * (o.x - r.x) + (o.y - r.y) * (o.y - r.y)) < 0.55e0 * 100)) = 0 THEN list_append(f.kept, {{'x': r.x, 'y': r.y}}) ELSE f.kept END,
  r.id, len(list_filter(f.kept, lambda o: sqrt((o.x - r.x) * (o.x - r.x) + (o.y - r.y) * (o.y - r.y)) < 0.55e0 * 100)) = 0 FROM f JOIN r ON r.label = f.label AND r.k = f.k + 1)
SELECT id, stands AS kept FROM f""",
    "hole_penalties": f"""WITH RECURSIVE {ASSIGNED}, gap AS (SELECT vec_id AS image_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x FROM embeddings, range(1, 65) t(i) WHERE round_even(128 + 256 * embedding[i]::DOUBLE, 0) > 140),
sp AS (SELECT *, y * 8 + x AS spot FROM gap), nb AS (SELECT a.image_id, a.spot AS s, b.spot AS t FROM sp a JOIN sp b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1),
re AS (SELECT image_id, s, t FROM nb UNION SELECT re.image_id, re.s, nb.t FROM re JOIN nb ON re.image_id = nb.image_id AND re.t = nb.s), lb AS (SELECT image_id, s, min(t) AS label FROM re GROUP BY ALL),
rg AS (SELECT image_id, label FROM lb GROUP BY ALL HAVING max((s // 8 IN (0, 7) OR s % 8 IN (0, 7))::INT) = 0), ho AS (SELECT vec_id, count(rg.label) AS holes FROM embeddings LEFT JOIN rg ON image_id = vec_id GROUP BY vec_id)
SELECT vec_id, holes, round(exp(-best * 10 / 2.2e0) * CASE abs(least(2, holes) - CASE WHEN number = 8 THEN 2 WHEN number IN (0, 4, 6, 9) THEN 1 ELSE 0 END) WHEN 0 THEN 1e0 WHEN 1 THEN 0.45e0 ELSE 0.18e0 END, 6) AS similarity FROM nr JOIN ho USING (vec_id)""",
}
