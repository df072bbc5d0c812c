"""From clusters to markers, and what users change, over the embedding, event and order tables, with SQL for the same rows.

Vectors are glyphs, their nearest label average their cluster, their first two components times 1000 their place; a label is an image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphtally.operators import counting as C, glyphs as G, markers as M, reading, spatial, vectors as V
from glyphtally.plans import raster_queries as RQ, table_queries as TQ, vector_queries as VQ


def _glyphs(spark, sf_dir) -> DataFrame:
    return V.glyphs(VQ.table(spark, sf_dir), keep=("label",))


def _members(spark, sf_dir) -> DataFrame:
    """(image_id, item, group, margin, x, y, score): vectors in the cluster of their nearest average; their label is the image."""
    near, *_ = VQ._assigned(spark, sf_dir)
    points = VQ._points(spark, sf_dir).withColumnsRenamed({"label": "image_id", "id": "item"})
    return near.select(F.col("vec_id").alias("item"), F.col("number").alias("group"), F.round("margin", 9).alias("margin")).join(points, "item")


def _groups(spark, sf_dir) -> DataFrame:
    """(group, place, members, spread, prototype, digit, similarity, number, sharpness): clusters by size; the similarity of a reading is made of the spread."""
    glyphs = _glyphs(spark, sf_dir)
    near, *_ = VQ._assigned(spark, sf_dir)
    own = glyphs.join(near.select("vec_id", F.col("number").alias("group")), "vec_id")
    protos = V.averages(own, "group")
    spread = V.spread(own, protos, "group").drop("sharpness").withColumn("spread", F.round("spread", 6))
    ranks = V.survivors(near.select("vec_id", F.col("number").alias("group")), "group").select("group", F.col("rank").alias("place"))
    rows = protos.select("group", F.transform("glyph", lambda v: F.round(v, 6)).alias("prototype")).join(spread, "group").join(ranks, "group")
    return M.group_rows(rows.withColumn("digit", F.col("group")).withColumn("similarity", F.round(1.1 - F.col("spread") - F.col("group") / 40, 6)))


def leader_seeds(spark, sf_dir):
    """Vectors by the first one close enough before them."""
    return V.leaders(_glyphs(spark, sf_dir), "vec_id", limit=0.8)


def refined_and_merged(spark, sf_dir):
    """Three passes over the labels as clusters: averages rebuilt, close ones merged, vectors assigned anew."""
    glyphs = _glyphs(spark, sf_dir)
    out = V.refine(glyphs.select("vec_id", "glyph"), glyphs.select("vec_id", F.col("label").alias("number")), "vec_id", "number", limit=0.2, digits=9)
    return out.groupBy("number").agg(F.count("*").alias("members"), F.round(F.avg("best"), 6).alias("spread"))


def dissolved_small(spark, sf_dir):
    """Every fiftieth vector is a cluster of its own; those dissolve among the labels."""
    glyphs = _glyphs(spark, sf_dir)
    members = glyphs.select("vec_id", F.when(F.col("vec_id") % 50 == 0, F.col("vec_id") + 100).otherwise(F.col("label")).alias("number"))
    return V.dissolve(glyphs.select("vec_id", "glyph"), members, "vec_id", "number", digits=9)


def group_rows(spark, sf_dir):
    g = _groups(spark, sf_dir)
    return g.select("group", "place", "members", "number", F.round("sharpness", 6).alias("sharpness"), F.array_join("prototype", " ").alias("prototype"), M.ambiguous(g).alias("ambiguous"))


def built_markers(spark, sf_dir):
    """Markers named by their clusters."""
    out = M.build_markers(_members(spark, sf_dir), _groups(spark, sf_dir))
    return out.drop("final_score").withColumn("detection_score", F.round("detection_score", 6))


def example_markers(spark, sf_dir):
    """Markers named one by one by the examples."""
    matches = VQ.example_matches(spark, sf_dir).withColumnRenamed("vec_id", "item")
    out = M.build_markers(_members(spark, sf_dir), _groups(spark, sf_dir), matches)
    return out.select("item", "final_number", F.round("final_score", 6).alias("final_score"), "confidence", "needs_review", "reason")


def assigned_counts(spark, sf_dir):
    groups = _groups(spark, sf_dir)
    matches = VQ.example_matches(spark, sf_dir).withColumnRenamed("vec_id", "item")
    return M.assigned_counts(M.build_markers(_members(spark, sf_dir), groups, matches), groups)


def discarded_detections(spark, sf_dir):
    m = _members(spark, sf_dir).select("image_id", "item", "margin")
    out = M.discarded(m.where("margin < 0.1").drop("margin"), m.where("margin >= 0.1 AND margin < 0.2").drop("margin"), "image_id", ["item"])
    return out.select("image_id", "item", "marker_id")


def image_stats(spark, sf_dir):
    """Labels as images whose pitch is twice the label."""
    m = _members(spark, sf_dir)
    images = m.select("image_id").distinct().withColumn("pitch", F.col("image_id") * 2.0)
    groups = m.select("image_id", F.when(F.col("group") % 3 > 0, F.col("group")).alias("number")).distinct()
    out = M.image_stats(images, m, m.where("margin >= 0.1"), groups, "image_id")
    return out.select("image_id", "proposed", "read", F.round("detection_yield", 6).alias("detection_yield"), F.round("radius", 6).alias("radius"), F.array_join("active", ",").alias("active"))


def _marker_points(spark, sf_dir) -> DataFrame:
    p = VQ._points(spark, sf_dir)
    number = (F.col("id") % 10 + 1).cast("int")
    return p.select("label", F.concat(F.lit("m"), F.col("id")).alias("marker_id"), "x", "y", (10.0 + F.col("id") % 7).alias("radius"), number.alias("final_number"),
                    F.lit(None).cast("int").alias("manual_number"), F.lit("medium").alias("confidence"), F.lit("group").alias("method"), "id")


def added_markers(spark, sf_dir):
    """Every seventh vector is a tap; labels from 7 on have no markers yet, those from 9 on not even an estimate."""
    p = _marker_points(spark, sf_dir)
    taps = p.where("id % 7 = 0").select("label", F.concat(F.lit("manual-"), F.col("id")).alias("marker_id"), "x", "y", F.col("final_number").alias("number"))
    estimates = p.select("label").distinct().select("label", F.when(F.col("label") < 9, 12.5).otherwise(0.0).alias("radius"))
    out = M.added(p.where("id % 7 <> 0 AND label < 7").drop("id"), taps, "label", estimates)
    return out.select("label", "marker_id", F.round("radius", 6).alias("radius"), "final_number", F.coalesce("manual_number", F.lit(0)).alias("manual_number"), "confidence", "method")


def confirmed_missed(spark, sf_dir):
    """A third of the vectors was missed; every other one of those is decided, by dismissal if its label is 0."""
    p = _marker_points(spark, sf_dir)
    missed = p.where("id % 3 = 1").select("label", "marker_id", "x", "y", "radius")
    choices = p.where("id % 6 = 1").select("label", "marker_id", F.when(F.col("label") > 0, F.col("final_number")).alias("number"))
    found, left = M.confirm_missed(p.where("id % 3 = 0").drop("id"), missed, choices, "label")
    return found.select("label", "marker_id", "confidence").unionByName(left.select("label", "marker_id", F.lit("missed").alias("confidence")))


def _examples(spark, sf_dir) -> DataFrame:
    return VQ._points(spark, sf_dir).select("label", "id", (F.col("id") % 10).cast("int").alias("digit"), "x", "y")


def added_examples(spark, sf_dir):
    """Taps a little beside every tenth vector, and far from every other tenth."""
    e = _examples(spark, sf_dir)
    taps = e.where("id % 5 = 0").withColumn("x", F.col("x") + F.when(F.col("id") % 10 == 0, 4).otherwise(4000)).withColumn("y", F.col("y") + 4).withColumn("id", F.col("id") + 1_000_000)
    return M.add_examples(e, taps, "label").select("label", "id", "digit")


def removed_examples(spark, sf_dir):
    """Taps beside every fifth vector, half of them for another digit; label 3 loses all sevens."""
    e = _examples(spark, sf_dir)
    taps = e.where("id % 5 = 0").withColumn("x", F.col("x") + 4).withColumn("digit", (F.col("digit") + F.col("id") % 2).cast("int"))
    whole = e.where("label = 3 AND digit = 7").withColumn("x", F.lit(None).cast("double"))
    return M.remove_examples(e, taps.unionByName(whole), "label").select("label", "id", "digit")


def example_digits(spark, sf_dir):
    e = _examples(spark, sf_dir)
    digits = M.example_digits(e.where("id % 3 > 0"), "label").select("label", F.array_join("digits", ",").alias("digits"))
    return M.examples_per_digit(e, "label").join(digits, "label")


def hit_markers(spark, sf_dir):
    taps = VQ._points(spark, sf_dir, 2)
    out = spatial.hit_test(taps, _marker_points(spark, sf_dir).select("label", "id", "x", "y", (F.col("radius") * 3).alias("radius")), "label", 40)
    return out.select("label", "id", F.coalesce("hit", F.lit(-1)).alias("hit"), F.coalesce(F.round("distance", 6), F.lit(-1.0)).alias("distance"))


def points_within(spark, sf_dir):
    p = VQ._points(spark, sf_dir)
    return spatial.within(p, p.where("id % 20 = 0"), "label", 90.0).select("label", "id", "rid", "place", F.round("distance", 6).alias("distance"))


def marker_recall(spark, sf_dir):
    """The markers at the vectors' second places against the first places as truth."""
    out = spatial.recall(VQ._points(spark, sf_dir, 2).where("id % 4 > 0"), VQ._points(spark, sf_dir), "label", 30.0)
    return out.withColumn("recall", F.round("recall", 6))


def calibrations(spark, sf_dir):
    e = lambda k: F.get("embedding", F.lit(k)).cast("double") * 1000
    out = M.calibration(VQ.table(spark, sf_dir).select("vec_id", *[e(k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]))
    return out.select("vec_id", F.round("pitch", 6).alias("pitch"), F.round("radius", 6).alias("radius"))


def overlay_rings(spark, sf_dir):
    p = _marker_points(spark, sf_dir).where("id % 25 = 0").withColumn("radius", 2 + F.col("id") % 7 / 4)
    p = p.withColumn("confidence", F.when(F.col("label") < 3, "high").when(F.col("label") < 6, "medium").otherwise("review"))
    return M.ring_points(p, ["id"])


def mean_rims(spark, sf_dir):
    return M.mean_rims(RQ.rim_colour(spark, sf_dir), "marker_id").select("marker_id", *[F.round(c, 5).alias(c) for c in "rgb"])


def debug_pages(spark, sf_dir):
    m = TQ.markers(spark, sf_dir).withColumn("reading", F.when(F.col("marker_id") % 2 == 0, F.lit(1)))
    pages = [M.debug_page(m, "image_id", which, 1, 5).select("image_id", "marker_id", "place", F.lit(which).alias("which")) for which in ("review", "grouped", "unread", "all")]
    return pages[0].union(pages[1]).union(pages[2]).union(pages[3])


def combined_readings(spark, sf_dir):
    """Every vector as a left glyph, scored by its distance from the averages; every third has the next vector as a right one."""
    glyphs, protos = VQ._by_label(spark, sf_dir)
    d = V.distances(glyphs, protos.withColumnRenamed("label", "digit"), "vec_id", "digit", 9)
    scores = d.select(F.col("vec_id").alias("image_id"), F.col("digit"), (1 - F.col("distance")).alias("similarity"))
    right = scores.where("image_id % 3 = 1").withColumn("image_id", F.col("image_id") - 1)
    parts = []
    for name, allowed in (("any", None), ("no ten", [1, 2, 3, 4])):
        parts.append(reading.combined(scores, right, allowed).select("image_id", F.lit(name).alias("allowed"), "value", F.round("confidence", 6).alias("confidence")))
    return parts[0].union(parts[1])


def split_outliers(spark, sf_dir):
    """Order lines beyond the fence of their part's quantities."""
    df = TQ._read(spark, sf_dir, "lineitem").withColumn("distance", F.pow(F.col("l_quantity") / 25, F.lit(2)))
    return spatial.split_outliers(df, "l_partkey", "distance").groupBy("l_partkey").agg(F.count("*").alias("lines"), F.count_if("rejected").alias("rejected"))


def price_percentiles(spark, sf_dir):
    return spatial.percentiles(TQ._read(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")


def truth_files(spark, sf_dir):
    """Hand-count files of the events' markers, as text."""
    return C.truth_documents(TQ.markers(spark, sf_dir), "image_id").select("image", C.truth_text().alias("json"))


def result_files(spark, sf_dir):
    m = TQ.markers(spark, sf_dir).withColumn("x", F.floor("value")).withColumn("y", F.floor(F.col("value") / 2)).withColumn("radius", F.lit(14))
    return C.json_documents(m, "image_id")


def evaluation_lines(spark, sf_dir):
    rows, _ = C.evaluate(*TQ._truth(spark, sf_dir), "image_id")
    return C.format_evaluation(rows, "image_id")


def applied_corrections(spark, sf_dir):
    """The last correction of each marker (an event of the same user some ids later) applied: a number or a rejection."""
    m = TQ.markers(spark, sf_dir)
    log = m.where("marker_id % 3 = 0").select("image_id", (F.col("marker_id") - F.col("marker_id") % 12).alias("marker_id"), F.col("marker_id").alias("seq"), (F.col("marker_id") % 10 + 1).cast("int").alias("number"), (F.col("marker_id") % 4 == 3).alias("reject"))
    last = C.fold_corrections(log, ["image_id", "marker_id"], "seq", ["number", "reject"])
    return C.count_summary(C.apply_corrections(m, last), "image_id")


def saved_examples(spark, sf_dir):
    """What was saved of each customer's newest orders, with an empty list for customers without any."""
    saved = C.newest(TQ._read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", tie="o_orderkey")
    out = C.saved_for(TQ._read(spark, sf_dir, "customer").select("c_custkey"), saved.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "o_orderkey")
    return out.select("c_custkey", F.array_join("saved", ",").alias("saved"))


QUERIES = {f.__name__: f for f in (
    leader_seeds, refined_and_merged, dissolved_small, group_rows, built_markers, example_markers, assigned_counts, discarded_detections, image_stats, added_markers, confirmed_missed,
    added_examples, removed_examples, example_digits, hit_markers, points_within, marker_recall, calibrations, overlay_rings, mean_rims, debug_pages, combined_readings, split_outliers,
    price_percentiles, truth_files, result_files, evaluation_lines, applied_corrections, saved_examples)}

PAIRS = """pd AS (SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN sum(greatest(a.c, b.c)) > 0 THEN sum(abs(a.c - b.c)) / sum(greatest(a.c, b.c)) ELSE 1e0 END AS d FROM cl a JOIN cl b ON a.pos = b.pos AND a.vec_id < b.vec_id GROUP BY ALL)"""


def _merge(protos: str, out: str, limit: str) -> str:
    """CTEs that merge close averages (number, pos, p) in order."""
    return f"""{out}_n AS (SELECT a.number AS a, b.number AS b FROM {protos} a JOIN {protos} b USING (pos) WHERE a.number < b.number GROUP BY ALL HAVING CASE WHEN sum(greatest(a.p, b.p)) > 0 THEN sum(abs(a.p - b.p)) / sum(greatest(a.p, b.p)) ELSE 1e0 END < {limit}),
{out}_i AS (SELECT number, row_number() OVER (ORDER BY number) AS k FROM (SELECT DISTINCT number FROM {protos})),
{out}_f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept, NULL::BIGINT AS id, NULL::BIGINT AS kept_as UNION ALL
  SELECT i.k, CASE WHEN h.a IS NULL THEN list_append(f.kept, i.number) ELSE f.kept END, i.number, coalesce(h.a, i.number) FROM {out}_f f JOIN {out}_i i ON i.k = f.k + 1
  LEFT JOIN {out}_n h ON h.b = i.number AND list_contains(f.kept, h.a) AND h.a = (SELECT min(q.a) FROM {out}_n q WHERE q.b = i.number AND list_contains(f.kept, q.a))),
{out} AS (SELECT kept_as AS number, pos, avg(p) AS p FROM {protos} JOIN {out}_f ON number = id WHERE k > 0 GROUP BY ALL)"""


def _pass(members: str, k: int) -> str:
    return f"""r{k} AS (SELECT number::BIGINT AS number, pos, avg(c) AS p FROM cl JOIN {members} USING (vec_id) GROUP BY ALL),
{_merge(f'r{k}', f'm{k}', '0.2e0')}, {VQ._dist('cl', f'm{k}', f'd{k}')}, {VQ._near(f'd{k}', f'n{k}')}"""


GROUPS = f"""{VQ.ASSIGNED}, gp AS (SELECT number AS grp, pos, avg(c) AS p FROM cl JOIN nr USING (vec_id) GROUP BY ALL),
gs AS (SELECT nr.number AS grp, vec_id, CASE WHEN sum(greatest(c, p)) > 0 THEN sum(abs(c - p)) / sum(greatest(c, p)) ELSE 1e0 END AS d FROM nr JOIN cl USING (vec_id) JOIN gp ON gp.grp = nr.number AND gp.pos = cl.pos GROUP BY ALL),
gg AS (SELECT grp, count(*) AS members, round(avg(d), 6) AS spread FROM gs GROUP BY grp),
gr AS (SELECT grp, members, spread, (row_number() OVER (ORDER BY members DESC, grp) - 1) AS place, greatest(0e0, least(1e0, 1 - 2.5e0 * spread)) AS sharpness,
  CASE WHEN round(1.1e0 - spread - grp / 40e0, 6) >= 0.72e0 THEN grp END AS number FROM gg WHERE members >= 3),
mb AS (SELECT label AS image_id, vec_id AS item, number AS grp, round(margin, 9) AS margin, embedding[6]::DOUBLE AS score FROM nr JOIN embeddings USING (vec_id))"""
BAND = "CASE WHEN gr.number IS NULL OR sharpness < 0.35e0 OR margin < 0.08e0 THEN 'review' WHEN sharpness < 0.6e0 OR margin < 0.2e0 OR members < 3 THEN 'medium' ELSE 'high' END"
MATCHES = VQ.ORACLES["example_matches"]
MP = """mp AS (SELECT label, vec_id AS id, 'm' || vec_id AS marker_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, 10e0 + vec_id % 7 AS radius, (vec_id % 10 + 1)::INT AS number FROM embeddings)"""
_D = VQ._D
_LEAD = "coalesce(greatest(0e0, least(1e0, {b} * (0.3e0 + 0.7e0 * least(1e0, CASE WHEN {b} > 0 THEN greatest(0e0, ({b} - {s}) / {b}) END / 0.35e0)))), 0e0)"

ORACLES = {
    "leader_seeds": f"""WITH RECURSIVE {VQ.CELLS}, {PAIRS}, nb AS (SELECT * FROM pd WHERE d < 0.8e0), it AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings),
f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept, NULL::BIGINT AS vec_id, NULL::BIGINT AS leader UNION ALL
  SELECT it.k, CASE WHEN h.a IS NULL THEN list_append(f.kept, it.vec_id) ELSE f.kept END, it.vec_id, coalesce(h.a, it.vec_id) FROM f JOIN it ON it.k = f.k + 1
  LEFT JOIN nb h ON h.b = it.vec_id AND h.a = (SELECT arg_min(q.a, (q.d, q.a)) FROM nb q WHERE q.b = it.vec_id AND list_contains(f.kept, q.a)))
SELECT vec_id, leader FROM f WHERE k > 0""",
    "refined_and_merged": f"WITH RECURSIVE {VQ.CELLS}, n0 AS (SELECT vec_id, label AS number FROM embeddings), {_pass('n0', 1)}, {_pass('n1', 2)}, {_pass('n2', 3)} SELECT number, count(*) AS members, round(avg(best), 6) AS spread FROM n3 GROUP BY number",
    "dissolved_small": f"""WITH {VQ.CELLS}, p AS (SELECT label::BIGINT AS number, pos, avg(c) AS p FROM cl WHERE vec_id % 50 <> 0 GROUP BY ALL HAVING count(*) >= 3), {VQ._dist('cl', 'p', 'd')}, {VQ._near('d', 'n')} SELECT vec_id, number FROM n""",
    "group_rows": f"""WITH {GROUPS}, pr AS (SELECT grp, string_agg(floor(round(p, 6) * 255 + 0.5e0)::INT, ' ' ORDER BY pos) AS prototype FROM gp GROUP BY grp)
SELECT grp AS "group", place, members, number, round(sharpness, 6) AS sharpness, prototype, number IS NULL OR members < 10 OR sharpness < 0.6e0 AS ambiguous FROM gr JOIN pr USING (grp)""",
    "built_markers": f"""WITH {GROUPS}, b AS (SELECT mb.*, gr.number AS final_number, place, members, {BAND} AS confidence FROM mb JOIN gr USING (grp))
SELECT image_id, item, grp AS "group", place, final_number, confidence, CASE WHEN final_number IS NULL THEN 'unknown' ELSE 'group' END AS method, final_number IS NULL OR confidence = 'review' AS needs_review,
CASE WHEN final_number IS NULL THEN 'Digit shape group ' || place || ' has not been named yet' ELSE 'Matched digit shape group ' || place || ', read as ' || final_number || ' from the average of ' || members || ' markers' END AS reason,
round(greatest(0e0, least(1e0, score / 200)), 6) AS detection_score FROM b""",
    "example_markers": f"""WITH mt AS ({MATCHES}) SELECT vec_id AS item, digit AS final_number, margin AS final_score, band AS confidence, band = 'review' AS needs_review, 'Matched the example you marked as ' || digit || ', on shape and bead colour' AS reason FROM mt""",
    "assigned_counts": f"""WITH {GROUPS}, mt AS ({MATCHES}) SELECT gr.grp AS "group", count(*) FILTER (digit = number) AS assigned FROM gr JOIN mb USING (grp) JOIN mt ON mt.vec_id = item GROUP BY gr.grp""",
    "discarded_detections": f"""WITH {GROUPS}, k AS (SELECT image_id, item, CASE WHEN margin < 0.1e0 THEN 'd' ELSE 'x' END AS kind FROM mb WHERE margin < 0.2e0)
SELECT image_id, item, kind || (row_number() OVER (PARTITION BY image_id, kind ORDER BY item) - 1) AS marker_id FROM k""",
    "image_stats": f"""WITH {GROUPS} SELECT image_id, CASE WHEN image_id > 2 THEN count(*) ELSE 0 END AS proposed, CASE WHEN image_id > 2 THEN count(*) FILTER (margin >= 0.1e0) ELSE 0 END AS read,
CASE WHEN image_id > 2 THEN round(count(*) FILTER (margin >= 0.1e0) / count(*)::DOUBLE, 6) ELSE 0e0 END AS detection_yield, CASE WHEN image_id > 2 THEN round(image_id * 2 * 0.46e0, 6) ELSE 0e0 END AS radius,
CASE WHEN image_id > 2 THEN coalesce(array_to_string(list_sort(list(DISTINCT grp) FILTER (grp % 3 > 0)), ','), '') ELSE '' END AS active FROM mb GROUP BY image_id""",
    "added_markers": f"""WITH {MP}, have AS (SELECT * FROM mp WHERE id % 7 <> 0 AND label < 7), m AS (SELECT label, avg(radius) AS r FROM have GROUP BY label)
SELECT label, marker_id, round(radius, 6) AS radius, number AS final_number, 0 AS manual_number, 'medium' AS confidence, 'group' AS method FROM have
UNION ALL SELECT label, 'manual-' || id, round(coalesce(r, CASE WHEN label < 9 THEN 12.5e0 END, 10e0), 6), number, number, 'high', 'manual' FROM mp LEFT JOIN m USING (label) WHERE id % 7 = 0""",
    "confirmed_missed": f"""WITH {MP} SELECT label, marker_id, 'medium' AS confidence FROM mp WHERE id % 3 = 0 UNION ALL SELECT label, 'recovered-' || marker_id, 'high' FROM mp WHERE id % 6 = 1 AND label > 0 UNION ALL SELECT label, marker_id, 'missed' FROM mp WHERE id % 3 = 1 AND id % 6 <> 1""",
    "added_examples": f"""WITH {MP}, tp AS (SELECT label, id + 1000000 AS id, id % 10 AS digit, x + CASE WHEN id % 10 = 0 THEN 4 ELSE 4000 END AS x, y + 4 AS y FROM mp WHERE id % 5 = 0)
SELECT label, id, (id % 10)::INT AS digit FROM mp a WHERE NOT EXISTS (SELECT 1 FROM tp b WHERE a.label = b.label AND {_D} <= 8) UNION ALL SELECT label, id, digit::INT FROM tp""",
    "removed_examples": f"""WITH {MP}, tp AS (SELECT label, id % 10 + id % 2 AS digit, x + 4 AS x, y FROM mp WHERE id % 5 = 0)
SELECT label, id, (id % 10)::INT AS digit FROM mp a WHERE NOT (label = 3 AND id % 10 = 7) AND NOT EXISTS (SELECT 1 FROM tp b WHERE a.label = b.label AND b.digit = a.id % 10 AND {_D} <= 8)""",
    "example_digits": f"""WITH {MP}, d AS (SELECT label, array_to_string(list_sort(list(DISTINCT id % 10)), ',') AS digits FROM mp WHERE id % 3 > 0 GROUP BY label)
SELECT label, (id % 10)::INT AS digit, count(*) AS examples, any_value(digits) AS digits FROM mp JOIN d USING (label) GROUP BY label, id % 10""",
    "hit_markers": f"""WITH {MP}, {VQ._pts('t', 2)}, h AS (SELECT a.id, b.id AS hit, {_D} AS d FROM t a JOIN mp b ON a.label = b.label WHERE {_D} < greatest(b.radius * 3 * 1.4e0, 40)),
f AS (SELECT id, arg_min(hit, (d, hit)) AS hit, min(d) AS d FROM h GROUP BY id) SELECT t.label, t.id, coalesce(f.hit, -1) AS hit, coalesce(round(f.d, 6), -1e0) AS distance FROM t LEFT JOIN f USING (id)""",
    "points_within": f"""WITH {MP}, w AS (SELECT a.label, a.id, b.id AS rid, {_D} AS d FROM mp a JOIN mp b ON a.label = b.label AND a.id % 20 = 0 WHERE {_D} <= 90)
SELECT label, id, rid, (row_number() OVER (PARTITION BY label, id ORDER BY d, rid))::INT AS place, round(d, 6) AS distance FROM w""",
    "marker_recall": f"""WITH {VQ._pts('m', 2)}, {VQ._pts('p', 0)}, k AS (SELECT label, count(*) AS markers, count(*) FILTER (EXISTS (SELECT 1 FROM p b WHERE a.label = b.label AND {_D} <= 36)) AS matched FROM m a WHERE id % 4 > 0 GROUP BY label)
SELECT label, count(*) AS truth, any_value(markers) AS markers, any_value(matched) AS matched, round(any_value(markers) / count(*)::DOUBLE, 6) AS recall FROM p JOIN k USING (label) GROUP BY label""",
    "calibrations": "WITH d AS (SELECT vec_id, 1000 * sqrt(pow(embedding[3]::DOUBLE - embedding[1]::DOUBLE, 2) + pow(embedding[4]::DOUBLE - embedding[2]::DOUBLE, 2)) AS d FROM embeddings) SELECT vec_id, round(d, 6) AS pitch, round(d * 0.46e0, 6) AS radius FROM d",
    "overlay_rings": f"""WITH {MP}, r AS (SELECT id, x, y, label, (2 + (id % 7) / 4e0) * 1.12e0 AS r FROM mp WHERE id % 25 = 0), s AS (SELECT *, greatest(24, floor(r * 8 + 0.5e0))::INT AS n FROM r),
k AS (SELECT s.*, k / n::DOUBLE * 2 * 3.141592653589793e0 AS t, b FROM s, range(0, 1000) q(k), range(-1, 2) z(b) WHERE k < n)
SELECT DISTINCT id, floor(x + cos(t) * (r + b) + 0.5e0)::INT AS px, floor(y + sin(t) * (r + b) + 0.5e0)::INT AS py, CASE WHEN label < 3 THEN 34 WHEN label < 6 THEN 14 ELSE 245 END AS r, CASE WHEN label < 3 THEN 197 WHEN label < 6 THEN 165 ELSE 158 END AS g, CASE WHEN label < 3 THEN 94 WHEN label < 6 THEN 233 ELSE 11 END AS b FROM k""",
    "mean_rims": f"WITH rc AS ({RQ.ORACLES['rim_colour']}) SELECT marker_id, round(avg(r), 5) AS r, round(avg(g), 5) AS g, round(avg(b), 5) AS b FROM rc GROUP BY marker_id",
    "debug_pages": f"""WITH {TQ.MARKERS}, w AS (SELECT image_id, marker_id, 'review' AS which FROM mk WHERE confidence = 'review' OR needs_review UNION ALL SELECT image_id, marker_id, 'grouped' FROM mk WHERE method = 'group'
UNION ALL SELECT image_id, marker_id, 'unread' FROM mk WHERE marker_id % 2 = 1 UNION ALL SELECT image_id, marker_id, 'all' FROM mk)
SELECT image_id, marker_id, (row_number() OVER (PARTITION BY image_id, which ORDER BY marker_id) - 1)::INT AS place, which FROM w QUALIFY place BETWEEN 5 AND 9""",
    "combined_readings": f"""WITH {VQ.PROTO}, {VQ._dist('cl', 'pt', 'ds')}, s AS (SELECT vec_id AS image_id, number AS digit, 1 - distance AS sim FROM ds),
o AS (SELECT image_id, max(sim) FILTER (digit = 1) AS one, max(sim) AS top FROM s GROUP BY image_id), z AS (SELECT image_id - 1 AS image_id, max(sim) FILTER (digit = 0) AS zero, max(sim) AS rtop FROM s WHERE image_id % 3 = 1 GROUP BY image_id),
a AS (SELECT o.image_id, name AS allowed, zero, sqrt(one * zero) AS ten, sqrt(top * rtop) AS rival, name = 'any' AND zero IS NOT NULL AS as_ten, CASE WHEN zero IS NULL THEN 1e0 ELSE 0.7e0 END AS w FROM o LEFT JOIN z USING (image_id), (VALUES ('any'), ('no ten')) t(name)),
r AS (SELECT a.image_id, allowed, digit, sim * w AS sc, row_number() OVER v AS k, lead(sim * w) OVER v AS nx FROM a JOIN s ON s.image_id = a.image_id AND digit <> 0 AND (allowed = 'any' OR digit IN (1, 2, 3, 4)) WINDOW v AS (PARTITION BY a.image_id, allowed ORDER BY sim DESC, digit))
SELECT a.image_id, a.allowed, CASE WHEN as_ten THEN 10 ELSE digit END::INT AS value, round(CASE WHEN as_ten THEN {_LEAD.format(b='ten', s='CASE WHEN ten = rival THEN 0e0 ELSE rival * 0.9e0 END')} ELSE {_LEAD.format(b='sc', s='coalesce(nx, 0e0)')} * CASE WHEN zero IS NULL THEN 1e0 ELSE 0.6e0 END END, 6) AS confidence FROM a JOIN r ON r.image_id = a.image_id AND r.allowed = a.allowed AND k = 1""",
    "split_outliers": """WITH v AS (SELECT l_partkey, pow(l_quantity / 25, 2) AS v FROM lineitem), m AS (SELECT l_partkey, list_sort(list(v)) AS l FROM v GROUP BY l_partkey),
q AS (SELECT l_partkey, len(l) AS n, l[floor(0.25e0 * (len(l) - 1))::INT + 1] AS q1, l[floor(0.75e0 * (len(l) - 1))::INT + 1] AS q3 FROM m),
f AS (SELECT l_partkey, CASE WHEN n < 20 THEN 1.4e0 ELSE greatest(1.4e0, q3 + 3 * (q3 - q1)) END AS f FROM q) SELECT l_partkey, count(*) AS lines, count(*) FILTER (v > f) AS rejected FROM v JOIN f USING (l_partkey) GROUP BY l_partkey""",
    "price_percentiles": "WITH m AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS l FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, len(l)::BIGINT AS n, " + ", ".join(f"l[floor({p}e0 * (len(l) - 1))::INT + 1] AS p{round(100 * p)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM m",
    "truth_files": f"""WITH {TQ.MARKERS}, c AS (SELECT image_id, {TQ.VALUE} AS number, count(*) AS n FROM mk WHERE NOT rejected AND {TQ.VALUE} IS NOT NULL GROUP BY ALL)
SELECT image_id AS image, '{{"image":"' || image_id || '","counts":{{' || string_agg('"' || number || '":' || n, ',' ORDER BY number) || '}},"total":' || sum(n)::BIGINT || ',"notes":"Verified by hand."}}' AS json FROM c GROUP BY image_id""",
    "result_files": f"""WITH {TQ.MARKERS}, c AS (SELECT image_id, {TQ.VALUE} AS number, count(*) AS n FROM mk WHERE NOT rejected AND {TQ.VALUE} IS NOT NULL GROUP BY ALL), s AS ({TQ._summary('mk')}),
k AS (SELECT image_id, string_agg('"' || number || '":' || n, ',' ORDER BY number) AS counts FROM c GROUP BY image_id),
l AS (SELECT image_id, string_agg('{{"id":"' || marker_id || '","x":' || floor(value)::BIGINT || ',"y":' || floor(value / 2)::BIGINT || ',"radius":14,' || coalesce('"number":' || {TQ.VALUE} || ',', '') || '"confidence":"' || CASE WHEN rejected THEN 'rejected' ELSE confidence END || '","method":"' || method || '","rejected":' || rejected || '}}', ',' ORDER BY marker_id) AS list FROM mk GROUP BY image_id)
SELECT image_id, '{{"version":1,"summary":{{"total":' || total || ',"counts":{{' || coalesce(counts, '') || '}},"high":' || high || ',"medium":' || medium || ',"review":' || review || ',"rejected":' || rejected || '}},"markers":[' || list || ']}}' AS json FROM s JOIN l USING (image_id) LEFT JOIN k USING (image_id)""",
    "evaluation_lines": f"""WITH {TQ.TRUTH} SELECT image_id, number, printf('    %2d: expected %4d detected %4d (%s, %.1f%%)', number, expected, detected, CASE WHEN difference >= 0 THEN '+' ELSE '' END || difference, round(accuracy * 100, 1)) AS line FROM er""",
    "applied_corrections": f"""WITH {TQ.MARKERS}, lg AS (SELECT image_id, marker_id - marker_id % 12 AS marker_id, max(marker_id) AS seq FROM mk WHERE marker_id % 3 = 0 GROUP BY ALL),
ap AS (SELECT mk.* REPLACE (CASE WHEN seq IS NOT NULL AND seq % 4 <> 3 THEN (seq % 10 + 1)::INT ELSE manual_number END AS manual_number, CASE WHEN seq IS NOT NULL THEN seq % 4 = 3 ELSE rejected END AS rejected) FROM mk LEFT JOIN lg USING (image_id, marker_id)) {TQ._summary('ap')}""",
    "saved_examples": """WITH s AS (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 8)
SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS saved FROM customer LEFT JOIN s ON o_custkey = c_custkey GROUP BY c_custkey""",
}
