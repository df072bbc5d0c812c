"""Linked sets folded by task and by rounds, and how many jobs they take."""

import random

from pyspark.sql import functions as F

from glyphtally.operators import detection, graph


def _edges(spark):
    r = random.Random(5)
    rows = [((k % 7, k % 2 == 0), a, b) for k in range(14) for _ in range(12) for a, b in [(r.randrange(40), r.randrange(40))]]
    rows += [((9, True), k, k + 1) for k in range(300)] + [((8, True), 1 << 40, 3), ((8, True), 5, 5)]
    return rows, spark.createDataFrame(rows, "g struct<a:long,b:boolean>, a long, b long")


def _heads(rows):
    head = {(g, n): n for g, a, b in rows if a != b for n in (a, b)}
    for _ in range(len(rows)):
        before = dict(head)
        for g, a, b in rows:
            if a != b:
                head[g, a] = head[g, b] = min(head[g, a], head[g, b])
        if head == before:
            return head


def test_folding_and_rounds(spark, monkeypatch):
    """All groups folded, in one task or several, the long path left to rounds, all of them left to rounds, and none at all."""
    rows, df = _edges(spark)
    want = _heads(rows)
    for fold in (200_000, 250, 0):
        monkeypatch.setattr(graph, "FOLD", max(fold, 1) if fold else 1)
        got = graph.connected(df, "g").collect()
        assert len(got) == len(want) and {((tuple(r.g)), r.spot): r.head for r in got} == want
    assert graph.connected(df.limit(0), "g").count() == 0


def test_few_jobs(spark):
    """A spiral of one component is long; its runs are folded in one go."""
    cells, y, x, dy, dx, side = set(), 0, 0, 0, 1, 24
    for length in [side - 1] + [n for k in range(side - 1, 1, -2) for n in (k, k)]:
        for _ in range(length):
            cells.add((y, x))
            y, x = y + dy, x + dx
        dy, dx = dx, -dy
    ink = spark.createDataFrame([(0, y, x) for y, x in cells], "image_id long, y int, x int").coalesce(1)
    sc = spark.sparkContext
    sc.setJobGroup("components", "components")
    try:
        labels = graph.components(ink).agg(F.count_distinct("label"), F.count("*")).first()
        jobs = len(sc.statusTracker().getJobIdsForGroup("components"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert tuple(labels) == (1, len(cells)) and jobs <= 24


def test_parts_are_folded_once(spark):
    """What is made of detections whose parts were joined does not fold them again."""
    rows = [(k, (k, n), 10.0 + n, 10.0, 10 + n, 11 + n, 8, 12, 0.0, 0.0, 0.0, 0.0, float(n), 20.0) for k in range(5) for n in range(3)]
    df = spark.createDataFrame(rows, "image_id long, id struct<image_id:long,number:long>, x double, y double, min_x int, max_x int, min_y int, max_y int, glyph_mean double, face_mean double, face_contrast double, roughness double, score double, pitch double")
    out = detection.merge_parts(df)
    assert "Pandas" not in out._jdf.queryExecution().toString() and "InArrow" not in out._jdf.queryExecution().toString()
    assert sorted((r.id.image_id, r.id.number, r.min_x, r.max_x, r.x, r.score) for r in out.collect()) == [(k, 0, 10, 13, 11.5, 2.0) for k in range(5)]
