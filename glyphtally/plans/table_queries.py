"""Counting, correcting, evaluating and exporting over the event, order and document tables, with SQL for the same rows.

An event is a marker: its user is the image, the `k` of its properties gives the number, the type the state: `error` is
rejected, `signup` set by hand, `purchase` unnamed; the value, over 100, is the score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtally.operators import counting as C, spatial


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markers(spark, sf_dir) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 10 + 1
    score = F.col("value") / 100
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("image_id"), F.col("event_id").alias("marker_id"), F.when(kind != "purchase", k).alias("final_number"),
        F.when(kind == "signup", k % 10 + 1).alias("manual_number"), F.when(score > 0.5, "high").when(score > 0.2, "medium").otherwise("review").alias("confidence"),
        F.round(score, 6).alias("score"), (kind == "error").alias("rejected"), (score <= 0.2).alias("needs_review"), "value", "ts", (k % 4).alias("shape_group"), kind.alias("method"))


MARKERS = """mk AS (SELECT user_id AS image_id, event_id AS marker_id, CASE WHEN event_type <> 'purchase' THEN k END AS final_number, CASE WHEN event_type = 'signup' THEN k % 10 + 1 END AS manual_number,
CASE WHEN value / 100 > 0.5e0 THEN 'high' WHEN value / 100 > 0.2e0 THEN 'medium' ELSE 'review' END AS confidence, round(value / 100, 6) AS score, event_type = 'error' AS rejected, value / 100 <= 0.2e0 AS needs_review, value, ts, k % 4 AS shape_group, event_type AS method
FROM (SELECT *, (props->>'$.k')::INT % 10 + 1 AS k FROM events))"""
VALUE = "coalesce(manual_number, final_number)"


def count_markers(spark, sf_dir):
    return C.count_summary(markers(spark, sf_dir), "image_id")


def count_rows_dense(spark, sf_dir):
    return C.count_rows(markers(spark, sf_dir), "image_id", dense=True)


def count_text(spark, sf_dir):
    return C.count_text(markers(spark, sf_dir), "image_id")


def confidence_histogram(spark, sf_dir):
    return C.confidence_histogram(_read(spark, sf_dir, "lineitem").withColumn("c", F.round(F.col("l_discount") * 10, 6)), "l_returnflag", "c", F.lit(1).cast("long"))


def review_queue(spark, sf_dir):
    q = C.review_queue(markers(spark, sf_dir), "image_id")
    return q.select("image_id", "place", "marker_id", F.round("priority", 6).alias("priority"))


def corrections_fold(spark, sf_dir):
    log = _read(spark, sf_dir, "conversations")
    return C.fold_corrections(log, ["conv_id"], "turn", ["role"])


def group_corrections(spark, sf_dir):
    """Group 1 of each image is renamed, group 3 of odd images rejected; then the counts."""
    m = markers(spark, sf_dir).withColumn("group", F.col("image_id") * 4 + F.col("shape_group"))
    groups = m.select("group", "image_id", "shape_group").distinct().select(
        "group", F.when(F.col("shape_group") == 1, (F.col("image_id") % 10 + 1).cast("int")).alias("new_number"), ((F.col("shape_group") == 3) & (F.col("image_id") % 2 == 1)).alias("reject"))
    return C.count_summary(C.apply_group_corrections(m, groups, "group"), "image_id")


def newest_saved(spark, sf_dir):
    return C.newest(_read(spark, sf_dir, "events"), "user_id", "ts", tie="event_id").select("user_id", "event_id", "place")


def _truth(spark, sf_dir):
    """Hand counts made of the markers of the image one further, so that they differ."""
    m = markers(spark, sf_dir).where(~F.col("rejected") & F.col("final_number").isNotNull())
    truth = m.groupBy((F.col("image_id") + 1).alias("image_id"), F.col("final_number").alias("number")).agg(F.count("*").alias("expected"))
    return truth, C.count_rows(markers(spark, sf_dir), "image_id").withColumnRenamed("count", "detected")


def evaluate_numbers(spark, sf_dir):
    rows, _ = C.evaluate(*_truth(spark, sf_dir), "image_id")
    return rows.withColumn("accuracy", F.round("accuracy", 6))


def evaluate_images(spark, sf_dir):
    _, total = C.evaluate(*_truth(spark, sf_dir), "image_id")
    return total.withColumn("accuracy", F.round("accuracy", 6))


def overlay_shown(spark, sf_dir):
    return C.shown(markers(spark, sf_dir), "high", [1, 2, 3, 4]).select("image_id", "marker_id", "colour_key")


def csv_lines(spark, sf_dir):
    m = markers(spark, sf_dir).withColumn("radius", F.lit(14.0)).withColumn("score", F.floor(F.col("value")) / 128 + 1e-4).withColumn("x", F.floor(F.col("value")) / 8 + 0.01).withColumn("y", F.floor(F.col("value")) / 2)
    return C.csv_lines(m, ["marker_id"])


def csv_quoting(spark, sf_dir):
    from glyphtally.functions.numeric import csv_field
    return _read(spark, sf_dir, "pages").select("page_id", csv_field(F.col("html")).alias("field"))


def size_band(spark, sf_dir):
    out = spatial.size_band(_read(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")
    return out.groupBy("l_suppkey").agg(F.count("*").alias("kept"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


def outlier_fence(spark, sf_dir):
    df = _read(spark, sf_dir, "lineitem").withColumn("distance", F.col("l_quantity") / 50)
    return spatial.outlier_fence(df, "l_partkey", "distance").withColumn("fence", F.round("fence", 6))


def dissolved_groups(spark, sf_dir):
    """Order groups by customer: small ones dissolve, the rest are ranked by size."""
    from glyphtally.operators.vectors import survivors
    return survivors(_read(spark, sf_dir, "orders"), "o_custkey").select("o_custkey", "members", "rank")


def content_fingerprint(spark, sf_dir):
    """The 32-bit FNV-1a fold over sampled characters of each page, in base 36."""
    p = _read(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("t"))
    step = F.greatest(F.lit(1), F.floor(F.length("t") / 32).cast("int"))
    codes = F.transform(F.when(F.length("t") > 0, F.sequence(F.lit(1), F.length("t"), step)).otherwise(F.array().cast("array<int>")), lambda i: F.ascii(F.substring(F.col("t"), i, F.lit(1))).cast("long"))
    fold = F.aggregate(codes, F.lit(2166136261), lambda h, v: F.pmod(h.bitwiseXOR(v) * F.lit(16777619), F.lit(4294967296)))
    return p.select("page_id", F.concat_ws("-", F.length("t").cast("string"), F.lower(F.conv(fold.cast("string"), 10, 36))).alias("signature"))


QUERIES = {f.__name__: f for f in (
    count_markers, count_rows_dense, count_text, confidence_histogram, review_queue, corrections_fold, group_corrections, newest_saved, evaluate_numbers, evaluate_images,
    overlay_shown, csv_lines, csv_quoting, size_band, outlier_fence, dissolved_groups, content_fingerprint)}


def _summary(src: str) -> str:
    return f"""SELECT image_id, count(*) FILTER (NOT rejected AND {VALUE} IS NOT NULL) AS total, count(*) FILTER (NOT rejected AND (manual_number IS NOT NULL OR confidence = 'high')) AS high,
count(*) FILTER (NOT rejected AND manual_number IS NULL AND confidence = 'medium') AS medium, count(*) FILTER (NOT rejected AND manual_number IS NULL AND confidence = 'review') AS review, count(*) FILTER (rejected) AS rejected FROM {src} GROUP BY image_id"""


TRUTH = f"""{MARKERS}, tr AS (SELECT image_id + 1 AS image_id, final_number AS number, count(*) AS expected FROM mk WHERE NOT rejected AND final_number IS NOT NULL GROUP BY ALL),
ct AS (SELECT image_id, {VALUE} AS number, count(*) AS detected FROM mk WHERE NOT rejected AND {VALUE} IS NOT NULL GROUP BY ALL),
ev AS (SELECT image_id, number, coalesce(expected, 0) AS expected, coalesce(detected, 0) AS detected FROM tr FULL JOIN ct USING (image_id, number)),
er AS (SELECT *, detected - expected AS difference, CASE WHEN expected = 0 THEN CASE WHEN detected = 0 THEN 1e0 ELSE 0e0 END ELSE greatest(0e0, 1 - abs(detected - expected) / expected::DOUBLE) END AS accuracy FROM ev)"""

ORACLES = {
    "count_markers": f"WITH {MARKERS} {_summary('mk')}",
    "count_rows_dense": f"WITH {MARKERS} SELECT i.image_id, n::INT AS number, count(m.marker_id) AS count FROM (SELECT DISTINCT image_id FROM mk) i CROSS JOIN range(1, 11) t(n) LEFT JOIN mk m ON m.image_id = i.image_id AND NOT m.rejected AND {VALUE} = n GROUP BY ALL",
    "count_text": f"WITH {MARKERS}, c AS (SELECT image_id, {VALUE} AS number, count(*) AS n FROM mk WHERE NOT rejected AND {VALUE} IS NOT NULL GROUP BY ALL) SELECT image_id, string_agg(number || ': ' || n, ', ' ORDER BY number) AS text FROM c GROUP BY image_id",
    "confidence_histogram": "WITH c AS (SELECT l_returnflag, least(9, greatest(0, floor(round(l_discount * 10, 6) * 10)))::INT AS bin FROM lineitem) SELECT f.l_returnflag, b::INT AS bin, count(c.bin) AS weight FROM (SELECT DISTINCT l_returnflag FROM c) f CROSS JOIN range(0, 10) t(b) LEFT JOIN c ON c.l_returnflag = f.l_returnflag AND c.bin = b GROUP BY ALL",
    "review_queue": f"WITH {MARKERS}, q AS (SELECT image_id, marker_id, coalesce(score, 0e0) + CASE WHEN final_number IS NULL THEN -1e0 ELSE 0e0 END AS priority FROM mk WHERE NOT rejected AND manual_number IS NULL AND (needs_review OR final_number IS NULL)) SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY priority, marker_id))::INT AS place, marker_id, round(priority, 6) AS priority FROM q",
    "corrections_fold": "SELECT conv_id, arg_max(role, turn) AS role, count(*) AS corrections FROM conversations GROUP BY conv_id",
    "group_corrections": f"""WITH {MARKERS}, ap AS (SELECT * REPLACE (CASE WHEN shape_group = 1 AND NOT rejected THEN (image_id % 10 + 1)::INT ELSE manual_number END AS manual_number, (rejected OR (shape_group = 3 AND image_id % 2 = 1)) AS rejected) FROM mk) {_summary('ap')}""",
    "newest_saved": "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))::INT AS place FROM events QUALIFY place <= 8",
    "evaluate_numbers": f"WITH {TRUTH} SELECT image_id, number, expected, detected, difference, round(accuracy, 6) AS accuracy FROM er",
    "evaluate_images": f"""WITH {TRUTH}, t AS (SELECT image_id, sum(expected)::BIGINT AS expected, sum(detected)::BIGINT AS detected, sum(difference)::BIGINT AS difference, sum(greatest(difference, 0))::BIGINT AS ov, sum(greatest(-difference, 0))::BIGINT AS un FROM er GROUP BY image_id)
SELECT image_id, expected, detected, difference, round(CASE WHEN expected = 0 THEN CASE WHEN detected = 0 THEN 1e0 ELSE 0e0 END ELSE greatest(0e0, 1 - abs(detected - expected) / expected::DOUBLE) END, 6) AS accuracy, greatest(0, -difference) AS missed, greatest(0, difference) AS extra, least(ov, un) AS misclassified_at_least FROM t""",
    "overlay_shown": f"WITH {MARKERS} SELECT image_id, marker_id, CASE WHEN rejected THEN 'rejected' WHEN manual_number IS NOT NULL THEN 'manual' WHEN confidence = 'review' THEN 'review' WHEN confidence = 'high' THEN 'high' ELSE 'medium' END AS colour_key FROM mk WHERE (manual_number IS NOT NULL OR confidence = 'high') AND {VALUE} IN (1, 2, 3, 4)",
    "csv_lines": f"""WITH {MARKERS}, n AS (SELECT *, floor(value) / 8 + 0.01e0 AS x, floor(value) / 2e0 AS y, floor(value) / 128 + 1e-4 AS sc FROM mk),
f AS (SELECT *, rtrim(rtrim(format('{{:.1f}}', x), '0'), '.') AS fx, rtrim(rtrim(format('{{:.1f}}', y), '0'), '.') AS fy, rtrim(rtrim(format('{{:.3f}}', sc), '0'), '.') AS fs FROM n)
SELECT marker_id, concat_ws(',', marker_id::VARCHAR, coalesce({VALUE}::VARCHAR, ''), fx, fy, '14', CASE WHEN rejected THEN 'rejected' ELSE confidence END, fs, '', '', shape_group::VARCHAR, method, CASE WHEN rejected THEN 'not-a-marker' WHEN needs_review THEN 'needs-review' ELSE 'accepted' END) AS line FROM f""",
    "csv_quoting": """SELECT page_id, coalesce(CASE WHEN regexp_matches(html, '[",\n]') THEN '"' || replace(html, '"', '""') || '"' ELSE html END, '') AS field FROM pages""",
    "size_band": """WITH m AS (SELECT l_suppkey, l_extendedprice AS v, list_sort(list(l_extendedprice) OVER (PARTITION BY l_suppkey)) AS l FROM lineitem),
k AS (SELECT l_suppkey, v FROM m WHERE len(l) < 12 OR v BETWEEN l[len(l) // 2 + 1] * 0.72e0 AND l[len(l) // 2 + 1] * 1.4e0) SELECT l_suppkey, count(*) AS kept, min(v) AS low, max(v) AS high FROM k GROUP BY l_suppkey""",
    "outlier_fence": """WITH m AS (SELECT l_partkey, list_sort(list(l_quantity / 50)) AS l FROM lineitem GROUP BY l_partkey),
q AS (SELECT l_partkey, len(l) AS n, l[floor(0.25e0 * (len(l) - 1))::INT + 1] AS q1, l[floor(0.75e0 * (len(l) - 1))::INT + 1] AS q3 FROM m) SELECT l_partkey, round(CASE WHEN n < 20 THEN 1.4e0 ELSE greatest(1.4e0, q3 + 3 * (q3 - q1)) END, 6) AS fence FROM q""",
    "dissolved_groups": "WITH s AS (SELECT o_custkey, count(*) AS members FROM orders GROUP BY o_custkey HAVING count(*) >= 3) SELECT o_custkey, members, (row_number() OVER (ORDER BY members DESC, o_custkey) - 1)::INT AS rank FROM s",
    "content_fingerprint": """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
c AS (SELECT page_id, length(t) AS n, list_transform(range(1, length(t) + 1, greatest(1, length(t) // 32)), lambda i: ord(t[i])::BIGINT) AS codes FROM p)
SELECT page_id, n || '-' || lower(to_base(list_reduce(codes, lambda h, v: (xor(h, v) * 16777619) % 4294967296, 2166136261::BIGINT), 36)) AS signature FROM c""",
}
