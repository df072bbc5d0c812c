"""Thresholds of the analysis, in one place. These are fixed values of the method."""

SUPPORTED_NUMBERS = range(1, 11)
SAUVOLA_K, SAUVOLA_RANGE = 0.28, 128.0
BLANK_DISTANCE = 1.0
JOIN_DISTANCE = 0.22
MERGE_DISTANCE = JOIN_DISTANCE * 0.8
REFINE_PASSES = 3
MIN_MEMBERS = 3
SHARPNESS_SLOPE = 2.5
COLOUR_WEIGHT, COLOUR_SCALE = 0.8, 60.0
RIM_INNER, RIM_OUTER = 0.18, 0.26
NMS_DISTANCE, SNAP_DISTANCE, SAME_POLARITY_BONUS = 0.55, 0.75, 1.25
SIZE_LOW, SIZE_HIGH, SIZE_POPULATION = 0.72, 1.4, 12
FENCE_DISTANCE, FENCE_SPREAD, FENCE_POPULATION = 1.4, 3.0, 20
STROKE_WIDTH, CHAMFER_SCALE, HOLE_PENALTIES = 0.14, 2.2, (1.0, 0.45, 0.18)
SAVED_IMAGES = 8
#: Bands of confidence: (review, medium) limits of sharpness and margin for groups, of distance and margin for examples.
GROUP_BANDS, MATCH_BANDS = ((0.35, 0.6), (0.08, 0.2)), ((1.4, 0.9), (0.05, 0.15))
NAME_SIMILARITY, RADIUS, SCORE_SCALE = 0.72, 0.46, 200.0
GLYPH_HEIGHT, GLYPH_WIDE, GLYPH_FILL = (0.12, 0.8), 1.6, 0.12
FACE_RADIUS, OUTER_RADIUS, FACE_SAMPLE, INK_CONTRAST, FACE_SLACK, FACE_WEIGHT = 0.22, 0.45, 8, 60.0, -6.0, 0.5
PART_DISTANCE, PART_BOX = 0.3, 0.55
GLYPH_SIZE, GLYPH_MARGIN = 32, 2
EXAMPLE_DISTANCE, HIT_FACTOR, TRUTH_FACTOR = 8.0, 1.4, 1.2
AMBIGUOUS_COUNT, AMBIGUOUS_SHARPNESS, PAGE_ROWS = 10, 0.6, 24
#: Spacing: longest edges that are searched, lags up to LEAST_RANGE or an eighth of the image, seeds as shares of its edge, and when a seed has settled.
WORK_EDGE, PERIOD_EDGE, LEAST_RANGE, RANGE_SHARE = 1000, 900, 120, 8
SEED_SHARES, SETTLED, SETTLE_ROUNDS, SETTLE_POPULATION, PERIOD_TRUST = (20, 40, 70), 0.06, 4, 8, 0.15
#: A marker of the declared size takes this share of the spacing; below LEAST_PITCH nothing is looked for.
MARKER_SHARE, LEAST_PITCH = 0.92, 4.0
#: Half the members of a group make a cell part of its digit.
STROKE_SHARE = 0.5
#: Tiles of markers: edge in radii of the marker, edge after resampling, clip of contrast in percent and amount of sharpening.
TILE_FACTOR, TILE_SIZE, TILE_LEAST, TILE_CLIP, TILE_SHARPEN = 2.7, 192, 8, 1.0, 0.9
#: Spokes from a tile's middle: how many, how many must meet the ring, the drop that is a ring, and in shares of the ring's radius the stretch of light, the stretch searched,
#: the radius without a ring, the least and the greatest one. Spokes agree within SPOKE_AGREE of the median; the centre ends at SPOKE_STOP of it.
SPOKES, SPOKES_MET, SPOKE_DROP = 24, 12, 45
SPOKE_LIGHT, SPOKE_SEARCH, NO_RING, CENTRE_RANGE = (0.15, 0.4), (0.4, 1.6), 0.62, (0.4, 0.85)
SPOKE_AGREE, SPOKE_STOP = 0.2, 0.9
#: Discs tried for a tile's digits beside the measured one, in shares of the ring's radius; pixels a disc needs.
DISC_SHARES, DISC_PIXELS = (0.5, 0.72, 0.85), 32
#: A digit in a disc: share of the disc's area, how near to the middle and how far out it comes, height and width in radii.
DISC_AREA, DISC_NEAR, DISC_FAR, DISC_HEIGHT, DISC_WIDTH = (0.012, 0.75), 0.55, 0.99, (0.35, 2.1), 1.8
#: Worth of a disc's digits: one or two of them, then for likely and unlikely height and fill each.
DISC_WORTH, TALL, TALL_WORTH, FULL, FULL_WORTH = (1.0, 0.8), (0.5, 1.7), (0.5, -0.4), (0.15, 0.85), (0.3, -0.2)
#: Ink of a cell of a tile's digit, and what agreement of two readings is worth.
CELL_SHARE, AGREEMENT = 0.4, 1.15
#: Radial symmetry: votes a place can count with (of radius 1, of others), and blur as a share of the radius.
VOTE_CAPS, VOTE_BLUR, PERCENTILE_BINS = (8.0, 9.9), 0.35, 2048
