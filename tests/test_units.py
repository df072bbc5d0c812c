import json
import math
import struct
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from glyphtally.functions.digits import raster
from glyphtally.functions.numeric import clamp8, csv_field, margin, plain_number, round_half_up
from glyphtally.operators import counting as C, detection as D, glyphs as G, graph, raster as R, reading, spatial, vectors as V
from glyphtally.operators.lineage import numbered, order_statistics
from glyphtally.sources import rasters

# A 4x4 cell of the 32x32 digit is '#' where at least 22 % of it is ink.
FINGERPRINTS = """
0 ...##... ..####.. ..#..#.. .##..##. .##..##. ..#..#.. ..####.. ...##...
1 ....#... ...##... ...##... ....#... ....#... ....#... ....#... ....#...
2 ...##... ..####.. .##..##. ....##.. ....#... ...##... ..####.. ..#####.
3 ...##... ..####.. .....#.. ...###.. ...###.. ..#..##. ..####.. ...##...
4 ....##.. ....##.. ...###.. ..####.. ..#.##.. .######. ....##.. ....##..
5 ..####.. ..####.. ..#..... ..####.. .....##. .....##. ..####.. ...##...
6 ........ ..##.... ..##.... ..####.. ..#..#.. ..#..##. ..####.. ...##...
7 ..####.. ..####.. ....##.. ....##.. ....#... ...##... ...#.... ...#....
8 ...##... ..####.. ..#..#.. ..####.. ..####.. .##..##. ..####.. ..####..
9 ...##... ..####.. ..#..##. ..#..#.. ..#####. .....#.. ....##.. ....#...
"""
HOLES = {0: 1, 1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0, 8: 2, 9: 1}


@pytest.mark.parametrize("row", FINGERPRINTS.split("\n")[1:-1])
def test_fingerprints(row):
    digit, *cells = row.split()
    ink = set(raster(int(digit), 32))
    got = ["".join("#" if sum((y, x) in ink for y in range(4 * a, 4 * a + 4) for x in range(4 * b, 4 * b + 4)) >= 3.52 else "." for b in range(8)) for a in range(8)]
    assert got == cells


def test_template_holes(spark):
    assert {r.digit: r.holes for r in reading.template_holes(spark, 32).collect()} == HOLES


def test_templates_read_themselves(spark):
    ink = reading.templates(spark, 32).toDF("image_id", "y", "x").withColumn("image_id", F.col("image_id").cast("long"))
    counters = spark.createDataFrame([(d, h) for d, h in HOLES.items()], "image_id long, holes long")
    scores = reading.similarity(reading.chamfer(ink, reading.templates(spark, 32), 32), counters, reading.template_holes(spark, 32))
    for r in reading.read(scores).collect():
        assert r.digit == r.image_id and r.similarity >= 1.25 * (r.similarity * (1 - r.confidence))


def test_rounding(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, -3.0, 300.0)], "x double")
    assert [r[0] for r in df.select(clamp8(F.col("x"))).collect()] == [0, 2, 2, 0, 255]
    assert [r[0] for r in df.select(round_half_up(F.col("x"))).collect()] == [1, 2, 3, -3, 300]


def test_margin(spark):
    df = spark.createDataFrame([(0.2, 0.4), (0.2, None), (0.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(margin(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 1.0]


def test_csv(spark):
    df = spark.createDataFrame([('a"b',), ("a,b",), ("a\nb",), ("ab",), (None,)], "t string")
    assert [r[0] for r in df.select(csv_field(F.col("t"))).collect()] == ['"a""b"', '"a,b"', '"a\nb"', "ab", ""]
    df = spark.createDataFrame([(14.0,), (1.25,), (0.5004,), (None,)], "x double")
    assert [r[0] for r in df.select(plain_number(F.col("x"), 3)).collect()] == ["14", "1.25", "0.5", ""]


def _px(spark, rows):
    return spark.createDataFrame([(0, y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id long, y int, x int, v int")


def test_ring(spark):
    ring = [[255 if 6 < math.hypot(x - 10, y - 10) < 9 else 0 for x in range(21)] for y in range(21)]
    px = _px(spark, ring)
    parts = graph.measures(graph.components(px.where("v > 0"))).collect()
    assert len(parts) == 1 and parts[0].area > 80
    assert graph.holes(px, F.col("v") > 0).collect()[0].holes == 1


def test_snake(spark):
    rows = [[1] * 12 if y % 2 == 0 else [int(x == (11 if y % 4 == 1 else 0)) for x in range(12)] for y in range(9)]
    assert graph.components(_px(spark, rows).where("v > 0"), diagonal=False).select("label").distinct().count() == 1


def test_otsu(spark):
    px = _px(spark, [[30] * 10] * 5 + [[220] * 10] * 3)
    assert 30 <= R.otsu(px).collect()[0].threshold < 220
    assert R.otsu(_px(spark, [[7, 7]])).collect()[0].threshold == 0


MARKER = "image_id long, marker_id long, final_number int, manual_number int, confidence string, rejected boolean"


def test_counts(spark):
    rows = [(1, "high", False), (1, "high", False), (2, "medium", False), (None, "review", False), (3, "high", True)]
    m = spark.createDataFrame([(0, k, n, None, c, r) for k, (n, c, r) in enumerate(rows)], MARKER)
    assert tuple(C.count_summary(m, "image_id").collect()[0]) == (0, 3, 2, 1, 1, 1)
    assert C.count_text(m, "image_id").collect()[0].text == "1: 2, 2: 1"
    assert C.count_rows(m, "image_id", dense=True).count() == 10
    manual = spark.createDataFrame([(0, 0, 4, 7, "review", False)], MARKER)
    assert [tuple(r) for r in C.count_rows(manual, "image_id").collect()] == [(0, 7, 1)]
    assert C.count_summary(m.where("false"), "image_id").count() == 0


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", n, c) for n, c in ((1, 142), (2, 317), (3, 201))], "image string, number int, expected long")
    found = spark.createDataFrame([("a", n, c) for n, c in ((1, 141), (2, 317), (3, 202))], "image string, number int, detected long")
    rows, total = C.evaluate(truth, found, "image")
    t = total.collect()[0]
    assert (t.difference, t.missed, t.misclassified_at_least) == (0, 0, 1)
    assert C.format_evaluation(rows, "image").orderBy("number").first().line == "     1: expected  142 detected  141 (-1, 99.3%)"


def test_truth_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"image": "a.png", "counts": {"1": 112, "10": 3}, "total": 115}))
    rows = {r.number: r.expected for r in rasters.truth_files(spark, str(tmp_path)).collect()}
    assert rows == {1: 112, 10: 3}


def test_json_documents(spark):
    rows = [(0, k, n, None, "high", False, 1.0, 2.0, 3.0, "group") for k, n in enumerate((10, 4, 2, 10))]
    m = spark.createDataFrame(rows, MARKER + ", x double, y double, radius double, method string")
    text = C.json_documents(m, "image_id").collect()[0].json
    got = json.loads(text)
    assert got["version"] == 1 and list(got["summary"]["counts"].items()) == [("2", 1), ("4", 1), ("10", 2)] and [x["number"] for x in got["markers"]] == [10, 4, 2, 10]
    assert '"2":1,"4":1,"10":2' in C.truth_documents(m, "image_id").select(C.truth_text()).collect()[0][0]


def _png(path, rows):
    raw = b"".join(b"\0" + bytes(c for p in row for c in p) for row in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files(spark, tmp_path):
    rows = [[(10, 20, 30), (200, 100, 50)], [(0, 0, 0), (255, 254, 253)]]
    _png(tmp_path / "a.png", rows)
    (tmp_path / "b.png").write_bytes(b"not an image")
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in rasters.file_pixels(rasters.image_files(spark, str(tmp_path))).collect()}
    assert got == {(y, x): rows[y][x] for y in range(2) for x in range(2)}


def test_large_images_are_averaged(spark, tmp_path):
    rows = [[(10 * y + x, 100, 2 * x) for x in range(8)] for y in range(6)]
    _png(tmp_path / "a.png", rows)
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in rasters.file_pixels(rasters.image_files(spark, str(tmp_path)), most=12).collect()}
    mean = lambda y, x, k: round(sum(rows[2 * y + j][2 * x + i][k] for j in (0, 1) for i in (0, 1)) / 4)  # noqa: E731  3 x 4 pixels of four each
    assert got == {(y, x): tuple(mean(y, x, k) for k in range(3)) for y in range(3) for x in range(4)}


@pytest.mark.parametrize("order", ["little", "big"])
def test_exif(order):
    n = lambda v, k: v.to_bytes(k, order)
    entry = lambda tag, v: n(tag, 2) + n(3, 2) + n(1, 4) + n(v, 2) + b"\0\0"
    tiff = (b"II" if order == "little" else b"MM") + n(42, 2) + n(8, 4) + n(2, 2) + entry(0x0100, 9) + entry(0x0112, 6) + n(0, 4)
    part = b"Exif\0\0" + tiff
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + (len(part) + 2).to_bytes(2, "big") + part + b"\xff\xda"
    assert rasters.exif_orientation(jpeg) == 6
    assert [rasters.exif_orientation(x) for x in (b"", b"\xff\xd8", b"\x89PNG", jpeg[:20], b"\xff\xd8\xff\xda\0\0")] == [1] * 5


def test_upright_and_orientations_of_files(spark, tmp_path):
    _png(tmp_path / "a.png", [[(1, 1, 1)]])
    assert [r.orientation for r in rasters.orientations(spark, str(tmp_path)).collect()] == [1]
    px = _px(spark, [[1, 2, 3], [4, 5, 6]])
    turned = R.upright(px, spark.createDataFrame([(0, 6)], "image_id long, orientation int"))
    assert {(r.y, r.x): r.v for r in turned.collect()} == {(0, 0): 4, (0, 1): 1, (1, 0): 5, (1, 1): 2, (2, 0): 6, (2, 1): 3}


def test_truth_by_base_name(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"image": "x", "counts": {"2": 5}}))
    images = spark.createDataFrame([("file:/a/b/one.v1.png",), ("file:/a/one.jpg",), ("file:/a/two.png",)], "path string")
    got = {r.path[-7:]: r.expected for r in rasters.truth_for(images, rasters.truth_files(spark, str(tmp_path))).collect()}
    assert got == {".v1.png": None, "one.jpg": 5, "two.png": None}


def test_contrast_with_everything_clipped(spark):
    got = [r.v for r in R.auto_contrast(_px(spark, [[3, 200], [90, 91]]), 100).orderBy("y", "x").collect()]
    assert got == [3, 200, 90, 91]


points = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(0, 9)), min_size=1, max_size=25)


@settings(max_examples=5, deadline=None)
@given(points)
def test_suppression(spark, pts):
    df = spark.createDataFrame([(0, i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(pts)], "g int, id long, x double, y double, rank double")
    got = {r.id for r in spatial.suppress(df, "g", 12.0).where("kept_as = id").collect()}
    want = []
    for i in sorted(range(len(pts)), key=lambda i: (-pts[i][2], i)):
        if all(math.hypot(pts[i][0] - pts[j][0], pts[i][1] - pts[j][1]) >= 12 for j in want):
            want.append(i)
    assert got == set(want)


def test_blank_distance(spark):
    df = spark.createDataFrame([(1, [0.0, -1.0]), (2, [0.5, 0.5]), (3, None)], "vec_id long, embedding array<float>")
    protos = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.5, 0.5])], "n int, glyph array<double>")
    got = {(r.vec_id, r.n): r.distance for r in V.distances(V.glyphs(df), protos, "vec_id", "n").collect()}
    assert got == {(1, 0): 1.0, (1, 1): 1.0, (2, 0): 1.0, (2, 1): 0.0}


def test_blank_image_is_far_from_all(spark):
    px = spark.createDataFrame([(0, y, x, 200) for y in range(8) for x in range(8)], "image_id long, y int, x int, v int")
    far = reading.chamfer(px.where("v < 100").select("image_id", "y", "x"), reading.templates(spark, 8), 8, px).collect()
    assert len(far) == 10 and {r.distance for r in far} == {reading.BLANK}


def test_small_fences(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(25)] + [("b", 9.0)], "g string, d double")
    assert {r.g: r.fence for r in spatial.outlier_fence(df, "g", "d").collect()} == {"a": 18 + 3 * 12.0, "b": 1.4}


def test_streamed_corrections(spark, tmp_path):
    from glyphtally.streaming.corrections import apply_corrections, corrections_stream, fold_stream
    log, kept, at = tmp_path / "log", str(tmp_path / "kept"), str(tmp_path / "at")
    log.mkdir()
    for k, (seq, number) in enumerate([(1, 3), (2, 5)]):
        (log / f"{k}.json").write_text(json.dumps({"image_id": 0, "marker_id": 1, "seq": seq, "number": number, "rejected": False}))
        fold_stream(corrections_stream(spark, str(log)), kept, at).awaitTermination()
    last = spark.read.parquet(f"{kept}/version=1")
    m = spark.createDataFrame([(0, 1, 4, None, "high", False), (0, 2, 4, None, "high", False)], MARKER)
    assert {r.marker_id: r.manual_number for r in apply_corrections(m, last).collect()} == {1: 5, 2: None}


def _blob(spark, at, height=8, width=3, page=80, level=30):
    """A page of light paper with dark bars at the given corners."""
    ink = {(y + j, x + i) for y, x in at for j in range(height) for i in range(width)}
    return _px(spark, [[level if (y, x) in ink else 230 for x in range(page)] for y in range(page)])


def test_detects_one_digit_per_marker(spark):
    at = [(10, 10), (10, 40), (40, 12), (42, 60)]
    got = D.detect(_blob(spark, at), 20.0).collect()
    assert sorted((round(r.y), round(r.x)) for r in got) == sorted((y + 4, x + 1) for y, x in at)
    assert all(r.score > 150 and not r.inverted and r.face_mean == 230 and r.glyph_mean == 30 for r in got)


def test_light_digits_only_where_enough_dark_ones_are(spark):
    dark = [(10, 10), (10, 40), (40, 10), (40, 40)]
    px = _blob(spark, dark).withColumn("v", F.when(F.col("y").between(55, 78) & F.col("x").between(55, 78), F.when(F.col("y").between(63, 70) & F.col("x").between(65, 67), 240).otherwise(25)).otherwise(F.col("v")))
    light = {(round(r.y), round(r.x), r.inverted) for r in D.detect_both(px, 20.0, least=4).collect()}
    assert light == {(y + 4, x + 1, False) for y, x in dark} | {(66, 66, True)}
    assert {r.inverted for r in D.detect_both(px, 20.0, least=8).collect()} == {False}
    tap = spark.createDataFrame([(0, 1, 66.0, 66.0)], "image_id long, id long, x double, y double")
    assert any(r.inverted for r in D.detect_for(px.join(spark.range(1).withColumnRenamed("id", "image_id"), "image_id"), 20.0, tap).collect()) is False  # fewer than eight


parts = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40), st.integers(1, 5), st.integers(1, 5), st.integers(0, 9)), min_size=1, max_size=12)


@settings(max_examples=4, deadline=None)
@given(parts)
def test_merging_parts(spark, boxes):
    pitch = 20.0
    items = [{"image_id": 0, "id": k, "x": x + (w - 1) / 2, "y": y + (h - 1) / 2, "min_x": x, "max_x": x + w - 1, "min_y": y, "max_y": y + h - 1, "score": float(s)} for k, (y, x, h, w, s) in enumerate(boxes)]
    want, open_ = [], list(items)
    while open_:
        group, rest = [open_[0]], []
        for r in open_[1:]:
            near = any(math.hypot(g["x"] - r["x"], g["y"] - r["y"]) < 6 for g in group)
            all_ = [*group, r]
            fits = max(g["max_x"] for g in all_) - min(g["min_x"] for g in all_) <= 11 and max(g["max_y"] for g in all_) - min(g["min_y"] for g in all_) <= 11
            (group if near and fits else rest).append(r)
        want.append((min(g["min_x"] for g in group), max(g["max_x"] for g in group), min(g["min_y"] for g in group), max(g["max_y"] for g in group), max(g["score"] for g in group)))
        open_ = rest
    df = spark.createDataFrame([(0, (0, i["id"]), i["x"], i["y"], i["min_x"], i["max_x"], i["min_y"], i["max_y"], 0.0, 0.0, 0.0, 0.0, i["score"]) for i in items],
                               "image_id long, id struct<image_id:long,number:long>, x double, y double, min_x int, max_x int, min_y int, max_y int, glyph_mean double, face_mean double, face_contrast double, roughness double, score double")
    assert sorted((r.min_x, r.max_x, r.min_y, r.max_y, r.score) for r in D.merge_parts(df.withColumn("pitch", F.lit(float(pitch)))).collect()) == sorted(want)


def test_extracted_digit_fills_its_raster(spark):
    px = _blob(spark, [(10, 10)], height=14, width=7, page=40)
    got = G.extract(px, D.detect(px, 24.0)).collect()[0]
    assert (got.aspect, got.density) == (0.5, 1.0) and len(got.data) == 1024
    rows = {k // 32 for k, v in enumerate(got.data) if v == 1.0}
    columns = {k % 32 for k, v in enumerate(got.data) if v == 1.0}
    assert rows == set(range(2, 30)) and columns == set(range(9, 23)) and abs(sum(got.glyph) - sum(got.data)) < 1e-6


def test_average_of_glyphs(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0], 1.0, 0.5), (0, [0.0, 0.0, 0.0, 1.0], 3.0, 0.7)], "g int, data array<double>, aspect double, density double")
    got = G.average_glyphs(df, "g", 2).collect()[0]
    assert got.data == [0.5, 0.0, 0.0, 0.5] and (got.aspect, got.density) == (2.0, 0.6) and abs(sum(got.glyph) - 1) < 1e-9


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 30)), min_size=1, max_size=60))
def test_order_statistics_and_numbers(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g int, v double")
    got = {r.g: (r.n, r.a, r.b) for r in order_statistics(df, "g", "v", {"a": F.floor(F.col("n") / 2), "b": F.floor(0.9 * (F.col("n") - 1))}).collect()}
    by = {g: sorted(v for h, v in rows if h == g) for g, _ in rows}
    assert got == {g: (len(s), s[len(s) // 2], s[math.floor(0.9 * (len(s) - 1))]) for g, s in by.items()}
    again = order_statistics(df, "g", "v", {"a": F.floor(F.col("n") / 2), "b": F.floor(0.9 * (F.col("n") - 1))}, bins=4, few=2)
    assert {r.g: (r.n, r.a, r.b) for r in again.collect()} == got
    placed = numbered(df, ["v", "g"], "k").collect()
    assert sorted(r.k for r in placed) == list(range(len(rows))) and [(r.v, r.g) for r in sorted(placed, key=lambda r: r.k)] == sorted((float(v), g) for g, v in rows)


def test_order_statistics_by_counts(spark):
    """A group of ties, values over the whole range of doubles, nulls and ranks beyond the group, with ranges narrowed until two rows are left."""
    values = [float("-inf"), -1e308, -5.0, -5.0, *[2.5] * 40, 2.5000001, 3.0, 1e-300, 0.0, 1e308, float("inf"), float("inf")]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0)] * 30 + [("c", None), ("d", 1.0), ("d", None)], "g string, v double")
    ranks = list(range(0, 55, 3))
    got = {r.g: r for r in order_statistics(df, "g", "v", {f"k{k}": F.lit(k) for k in ranks}, bins=4, few=2).collect()}
    assert [got["a"][f"k{k}"] for k in ranks] == [sorted(values)[k] if k < len(values) else None for k in ranks]
    assert set(got) == {"a", "b", "d"} and got["b"].n == 30 and {got["b"][f"k{k}"] for k in ranks if k < 30} == {7.0} and (got["d"].k0, got["d"].k3) == (1.0, None)


def test_no_survivors_keeps_all(spark):
    df = spark.createDataFrame([(k, k // 2) for k in range(6)], "id long, g int")
    assert {r.g: r.rank for r in V.survivors(df, "g").collect()} == {0: 0, 1: 1, 2: 2}
    glyphs = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(6)], "id long, glyph array<double>")
    assert {(r.id, r.g) for r in V.dissolve(glyphs, df, "id", "g").collect()} == {(k, k // 2) for k in range(6)}
