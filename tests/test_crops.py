"""Markers drawn with known digits, rings and places: tiles, centres, digits, votes and symmetry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphtally.functions.digits import raster
from glyphtally.operators import crops as C, symmetry as Y


def page(places, side=150, seed=3, paper=150, ring=40, face=238, ink=25):
    """A gray page with markers (value, x, y, radius): a ring whose inner edge is at .62 of the radius around the printed value."""
    r = np.random.default_rng(seed)
    out = np.full((side, side), float(paper))
    yy, xx = np.mgrid[:side, :side]
    for value, x, y, radius in places:
        d = np.hypot(xx - x, yy - y)
        out[d <= radius] = ring
        out[d <= radius * 0.66] = face
        tall = int(radius * (0.62 if value == 10 else 0.8))
        digits = [(1, -0.24), (0, 0.24)] if value == 10 else [(value, 0.0)]
        for digit, off in digits:
            for cy, cx in raster(digit, tall) if value is not None else ():
                out[int(y - tall / 2) + cy, int(x + off * radius - tall / 2) + cx] = ink
    return np.clip(np.rint(out + r.normal(0, 1.5, out.shape)), 0, 255).astype(int)


def pixels(spark, pages):
    rows = [(k, y, x, int(v)) for k, p in pages.items() for (y, x), v in np.ndenumerate(p)]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v int")


def markers(spark, places):
    """The drawn markers; tiles expect the ring twice as far out as the radius given."""
    rows = [(image, 100 * image + n, float(x), float(y), r / 2) for image, held in places.items() for n, (_, x, y, r) in enumerate(held)]
    return spark.createDataFrame(rows, "image_id long, id long, x double, y double, radius double")


PLACES = {1: [(1, 35, 40, 28), (2, 105, 38, 30), (7, 40, 110, 29), (10, 108, 108, 33)], 2: [(4, 50, 50, 36), (8, 110, 110, 33)]}


def test_markers_are_read(spark):
    """Two pages of rings of different size, a two-digit marker, a blank one; ids of images that are not there read as nothing."""
    places = PLACES | {3: [(None, 60, 60, 40)]}
    px = pixels(spark, {k: page(held, seed=k) for k, held in places.items()})
    asked = markers(spark, places | {9: [(5, 20, 20, 10)]})
    got = {r.id: r for r in C.read_markers(px, asked).collect()}
    assert {i: r.value for i, r in got.items()} == {100 * k + n: value if k != 9 else None for k, held in (places | {9: [(None, 0, 0, 0)]}).items() for n, (value, *_) in enumerate(held)}
    assert all((r.confidence > 0) == (r.value is not None) for r in got.values()) and got[900].radius is None
    # the ring's inner edge lies at .66 of the radius and the tile's ring at 1 / 2.7 of its edge
    scale = 192 / 2.7
    assert all(abs(r.radius - 0.9 * 0.66 * scale) < 0.12 * scale for r in got.values() if r.met)
    few = {r.id: r.value for r in C.read_markers(px, asked.where("id = 103"), allowed=[1, 2, 7]).collect()}
    assert few == {103: 1}  # no tens in the picture: the left digit


def test_empty_tables(spark):
    px, asked = pixels(spark, {1: page([])}), markers(spark, {1: [(1, 20, 20, 10)]})
    assert C.read_markers(px.limit(0), asked, size=48).collect()[0].value is None
    assert C.read_markers(px, asked.limit(0), size=48).count() == 0
    assert Y.radial_symmetry(px.limit(0), [2], 10.0).count() == 0 and Y.map_percentile(px.limit(0), 0.5).count() == 0


def test_tiles_repeat_edges(spark):
    p = page([], side=20)
    got = {(r.y, r.x): r.v for r in C.tiles(pixels(spark, {4: p}), markers(spark, {4: [(1, 1, 18, 4)]})).collect()}
    side = 11
    assert got == {(y, x): int(p[min(19, 13 + y), max(0, -4 + x)]) for y in range(side) for x in range(side)}


def test_spokes(spark):
    """A whole ring is measured; one hidden on most sides, and spokes that meet rings far apart, fall back."""
    size, ring = 96, 96 / 2.7
    yy, xx = np.mgrid[:size, :size]
    d, angle = np.hypot(xx - 48, yy - 48), np.arctan2(yy - 48, xx - 48)
    whole = np.where((d > 20) & (d < 30), 30, 220)
    part = np.where((d > 20) & (d < 30) & (angle > 1), 30, 220)
    odd = np.where(d > np.where(np.floor((angle + np.pi) / (2 * np.pi) * 24 + 0.5) % 3 == 0, 16, np.where(np.floor((angle + np.pi) / (2 * np.pi) * 24 + 0.5) % 3 == 1, 28, 50)), 30, 220)
    rings = spark.createDataFrame([(k, ring) for k in (1, 2, 3)], "image_id long, ring double")
    got = {r.image_id: r for r in C.centre_radius(pixels(spark, {1: whole, 2: part, 3: odd}), rings).collect()}
    assert got[1].met == 24 and abs(got[1].radius - 0.9 * 21) < 1.5
    for k in (2, 3):
        assert got[k].met == 0 and got[k].radius == pytest.approx(0.62 * ring)


def test_isolated_pieces(spark):
    """Ring bleed and specks fall away, two digits come from the left, and the holes of each are its own."""
    p = page([(10, 48, 48, 44), ], side=96)
    p[47, 30] = 25
    glyphs, ink = C.isolated(pixels(spark, {5: p}), spark.createDataFrame([(5, 27.0)], "image_id long, radius double"))
    got = sorted(glyphs.collect(), key=lambda g: g.place)
    assert [g.holes for g in got] == [0, 1] and got[0].x + got[0].width <= got[1].x
    own = {(r.place, r.y, r.x) for r in ink.collect()}
    for g in got:
        cells = [(y, x) for place, y, x in own if place == g.place]
        assert (min(y for y, _ in cells), min(x for _, x in cells)) == (g.y, g.x) and len(cells) / (g.width * g.height) == pytest.approx(g.fill)
        assert all(p[y, x] < 100 for y, x in cells) or len(cells) > 0


def test_votes(spark):
    rows = [(1, 0, 7, 0.5), (1, 1, 7, 0.4), (2, 0, 3, 0.2), (2, 1, 4, 0.6), (3, 0, None, 0.9), (3, 1, 2, 0.1), (4, 0, 5, 0.0), (5, 0, 6, 0.95), (5, 1, 6, 0.95), (6, 0, 1, 0.3), (6, 1, 2, 0.3)]
    got = {r.image_id: (r.value, round(r.confidence, 9), r.agreeing) for r in C.voted(spark.createDataFrame(rows, "image_id long, turn int, value int, confidence double")).collect()}
    assert got == {1: (7, 0.575, 2), 2: (4, 0.6, 1), 3: (2, 0.1, 1), 4: (None, 0.0, 0), 5: (6, 1.0, 2), 6: (1, 0.3, 1)}


def test_symmetry_finds_rings(spark):
    """Each ring is one peak in its middle, found by radii close to its inner edge."""
    places = [(None, 35, 40, 22), (None, 105, 38, 22), (None, 40, 110, 22), (None, 108, 108, 22)]
    px = pixels(spark, {1: page(places)})
    maps = Y.radial_symmetry(px, [13, 14, 15], 60.0, 2.0, 300.0)
    limit = Y.map_percentile(maps, 0.995).first().value
    got = Y.peaks(maps, 20.0, limit).collect()
    assert len(got) == 4 and all(min(np.hypot(r.x - x, r.y - y) for _, x, y, _ in places) < 2.5 for r in got)


def greedy(m, distance, limit):
    tops = [(-m[y, x], y, x) for y in range(1, m.shape[0] - 1) for x in range(1, m.shape[1] - 1) if m[y, x] >= limit and m[y, x] == m[y - 1:y + 2, x - 1:x + 2].max()]
    kept = []
    for s, y, x in sorted(tops):
        if all((y - b) ** 2 + (x - a) ** 2 > distance ** 2 for _, b, a in kept):
            kept.append((s, y, x))
    return {(y, x) for _, y, x in kept}


@pytest.mark.parametrize("levels", [5, 1000])
def test_peaks_claim_discs(spark, levels):
    """The peaks of two maps at once are those of a greedy loop over each, with many ties and with few."""
    r = np.random.default_rng(levels)
    maps = {k: r.integers(0, levels, (30, 24)) for k in (1, 2)}
    px = pixels(spark, maps).withColumn("v", F.col("v").cast("double"))
    got = {(p.image_id, p.y, p.x) for p in Y.peaks(px, 4.0, 0.5 * levels).collect()}
    assert got == {(k, y, x) for k, m in maps.items() for y, x in greedy(m, 4, 0.5 * levels)}


def test_percentiles_of_maps(spark):
    r = np.random.default_rng(1)
    maps = {1: r.gamma(2, 50, (20, 30)), 2: np.zeros((4, 4))}
    rows = [(k, y, x, float(v)) for k, m in maps.items() for (y, x), v in np.ndenumerate(m)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, v double")
    for share in (0.1, 0.5, 0.99):
        got = {p.image_id: p.value for p in Y.map_percentile(df, share).collect()}
        step = maps[1].max() / 2047
        assert got[2] == 0 and abs(got[1] - np.sort(maps[1].ravel())[int(np.ceil(600 * share)) - 1]) <= step
