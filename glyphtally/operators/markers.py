"""From clusters to markers: group rows, naming, discards, statistics; and what a user changes by hand.

Clusters are (group, members, spread, sharpness, ...), members (image_id, item, group, margin, x, y, score).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtally import settings as S
from glyphtally.functions.numeric import group_band, match_band, round_half_up
from glyphtally.operators.spatial import as_right, near_pairs


def group_rows(groups: DataFrame) -> DataFrame:
    """(group, members, spread, prototype, digit, similarity, confidence, ...) with number (null below NAME_SIMILARITY), sharpness and the prototype as levels."""
    out = groups.withColumn("number", F.when(F.col("similarity") >= S.NAME_SIMILARITY, F.col("digit")))
    out = out.withColumn("sharpness", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - S.SHARPNESS_SLOPE * F.col("spread"))))
    return out.withColumn("prototype", F.transform("prototype", lambda v: round_half_up(v * 255).cast("int")))


def ambiguous(groups: DataFrame) -> Column:
    """Whether a group asks for a look: unnamed, few or blurred."""
    return F.col("number").isNull() | (F.col("members") < S.AMBIGUOUS_COUNT) | (F.col("sharpness") < S.AMBIGUOUS_SHARPNESS)


def mean_rims(rims: DataFrame, group: str) -> DataFrame:
    """(group, r, g, b): the mean colour of the members' rims."""
    return rims.groupBy(group).agg(*[F.avg(c).alias(c) for c in "rgb"])


def example_digits(examples: DataFrame, by: str) -> DataFrame:
    """(by, digits): the numbers that have examples, in order; they replace an allowed set."""
    return examples.groupBy(by).agg(F.array_sort(F.collect_set("digit")).alias("digits"))


def examples_per_digit(examples: DataFrame, by: str) -> DataFrame:
    return examples.groupBy(by, "digit").agg(F.count("*").alias("examples"))


def build_markers(members: DataFrame, groups: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Members with their number, score, level, method, whether to look at them, and why.

    ``groups`` (group, place, number, sharpness, members). Without ``matches`` a member has its group's number; with ``matches`` (item, digit, distance,
    margin) that of its nearest example.
    """
    met = members.join(groups.select("group", "place", F.col("number").alias("group_number"), "sharpness", F.col("members").alias("group_members")), "group")
    shape = F.format_string("Matched digit shape group %d, read as %d from the average of %d markers", "place", "group_number", "group_members")
    if matches is None:
        number, score, why = F.col("group_number"), F.col("margin"), shape
        level = group_band(F.col("group_number"), F.col("sharpness"), F.col("margin"), F.col("group_members"))
    else:
        met = met.join(matches.select("item", "digit", "distance", F.col("margin").alias("match_margin")), "item")
        number, score = F.col("digit"), F.col("match_margin")
        level = match_band(F.col("digit"), F.col("distance"), F.col("match_margin"))
        why = F.format_string("Matched the example you marked as %d, on shape and bead colour", "digit")
    met = met.withColumn("final_number", number).withColumn("final_score", score).withColumn("confidence", level)
    return met.select(
        "image_id", "item", "group", "place", "final_number", "final_score", "confidence", F.when(F.col("final_number").isNull(), "unknown").otherwise("group").alias("method"),
        (F.col("final_number").isNull() | (F.col("confidence") == "review")).alias("needs_review"),
        F.when(F.col("final_number").isNull(), F.format_string("Digit shape group %d has not been named yet", "place")).otherwise(why).alias("reason"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / S.SCORE_SCALE)).alias("detection_score"))


def with_names(markers: DataFrame, by: str, prefix: str, order: list) -> DataFrame:
    """``markers`` with marker_id: the prefix and the place within the image from 0 on."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return markers.withColumn("marker_id", F.concat(F.lit(prefix), place.cast("string")))


def assigned_counts(markers: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, assigned): markers of a group that bear the group's number; none for an unnamed group's unnamed markers either way."""
    met = markers.join(groups.select("group", "number"), "group", "right")
    same = F.col("final_number").eqNullSafe(F.col("number")) & F.col("item").isNotNull()
    return met.groupBy("group").agg(F.count_if(same).alias("assigned"))


def discarded(without_glyph: DataFrame, not_markers: DataFrame, by: str, order: list) -> DataFrame:
    """Detections that carry no number: those without a digit (d0, d1, ...), then those that resemble no example (x0, x1, ...)."""
    return with_names(without_glyph, by, "d", order).unionByName(with_names(not_markers, by, "x", order))


def image_stats(images: DataFrame, detections: DataFrame, read: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """One row per image (by, pitch): proposed, read, detection_yield, radius and active numbers; an image without a pitch above 4 has nothing of it."""
    found = detections.groupBy(by).agg(F.count("*").alias("proposed")).join(read.groupBy(by).agg(F.count("*").alias("read")), by, "left")
    numbers = groups.where("number IS NOT NULL").groupBy(by).agg(F.array_sort(F.collect_set("number")).alias("active"))
    out = images.join(found, by, "left").join(numbers, by, "left")
    some = F.coalesce(F.col("pitch") > 4, F.lit(False))
    count = lambda c: F.when(some, F.coalesce(c, F.lit(0))).otherwise(F.lit(0))
    out = out.withColumn("proposed", count("proposed")).withColumn("read", count("read"))
    return out.select(
        by, "proposed", "read", F.when(F.col("proposed") > 0, F.col("read") / F.greatest("proposed", F.lit(1))).otherwise(0.0).alias("detection_yield"),
        F.when(some, F.col("pitch") * S.RADIUS).otherwise(0.0).alias("radius"), F.when(some, F.coalesce("active", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")).alias("active"))


def added(markers: DataFrame, taps: DataFrame, by: str, estimates: DataFrame | None = None) -> DataFrame:
    """``markers`` (by, marker_id, x, y, radius, final_number, manual_number, confidence, method) with taps (by, marker_id, x, y, number) added by hand.

    Their radius is the mean of the image's markers, else the estimate (by, radius), else 10.
    """
    mean = markers.groupBy(by).agg(F.avg("radius").alias("__mean"))
    met = taps.join(mean, by, "left")
    guess = F.lit(None).cast("double")
    if estimates is not None:
        met, guess = met.join(estimates.select(by, F.col("radius").alias("__guess")), by, "left"), F.nullif(F.col("__guess"), F.lit(0.0))
    return markers.unionByName(met.select(by, "marker_id", "x", "y", F.coalesce("__mean", guess, F.lit(10.0)).alias("radius"), *_by_hand()))


def _by_hand() -> list[Column]:
    return [F.col("number").alias("final_number"), F.col("number").alias("manual_number"), F.lit("high").alias("confidence"), F.lit("manual").alias("method")]


def confirm_missed(markers: DataFrame, missed: DataFrame, choices: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """``markers`` with the missed candidates (by, marker_id, x, y, radius) that ``choices`` (by, marker_id, number) names, and the candidates left; a null number dismisses."""
    named = missed.join(choices.where("number IS NOT NULL"), [by, "marker_id"])
    found = named.select(by, F.concat(F.lit("recovered-"), F.col("marker_id")).alias("marker_id"), "x", "y", "radius", *_by_hand())
    return markers.unionByName(found), missed.join(choices.select(by, "marker_id"), [by, "marker_id"], "left_anti")


def add_examples(examples: DataFrame, taps: DataFrame, by: str) -> DataFrame:
    """``examples`` (by, id, digit, x, y) after taps: those within EXAMPLE_DISTANCE of a tap are replaced by it."""
    near = near_pairs(examples.select(by, "id", "x", "y"), as_right(taps.select(by, "id", "x", "y")), by, F.lit(S.EXAMPLE_DISTANCE)).where(F.col("distance") <= S.EXAMPLE_DISTANCE)
    return examples.join(near.select(by, "id").distinct(), [by, "id"], "left_anti").unionByName(taps.select(*examples.columns))


def remove_examples(examples: DataFrame, taps: DataFrame, by: str) -> DataFrame:
    """``examples`` without those of a tap's digit within EXAMPLE_DISTANCE of it; a tap without a place takes all of its digit."""
    placed = taps.where("x IS NOT NULL AND y IS NOT NULL")
    near = near_pairs(examples.select(by, "id", "x", "y", "digit"), as_right(placed.select(by, "id", "x", "y")).join(placed.select(F.col("id").alias("rid"), F.col("digit").alias("rdigit")), "rid"), by, F.lit(S.EXAMPLE_DISTANCE))
    near = near.where((F.col("distance") <= S.EXAMPLE_DISTANCE) & (F.col("digit") == F.col("rdigit")))
    whole = taps.where("x IS NULL OR y IS NULL").select(by, "digit").distinct()
    return examples.join(near.select(by, "id").distinct(), [by, "id"], "left_anti").join(whole, [by, "digit"], "left_anti").select(*examples.columns)


def debug_page(markers: DataFrame, by: str, which: str, page: int, rows: int = S.PAGE_ROWS) -> DataFrame:
    """One page of each image's markers: those to review, those named by their group, those not read, or all."""
    keep = {"review": (F.col("confidence") == "review") | F.col("needs_review"), "grouped": F.col("method") == "group", "unread": F.col("reading").isNull()}.get(which, F.lit(True))
    place = F.row_number().over(Window.partitionBy(by).orderBy("marker_id")) - 1
    return markers.where(keep).withColumn("place", place).where((F.col("place") >= page * rows) & (F.col("place") < (page + 1) * rows))


def calibration(taps: DataFrame) -> DataFrame:
    """pitch and radius of two taps (x0, y0, x1, y1) on neighbouring markers."""
    pitch = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return taps.withColumn("pitch", pitch).withColumn("radius", F.col("pitch") * S.RADIUS)


def ring_points(markers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, px, py, r, g, b): the pixels of an overlay ring of three circles around each marker, coloured by its level."""
    radius = F.col("radius") * 1.12
    steps = F.greatest(F.lit(24), round_half_up(radius * 8)).cast("int")
    at = markers.select(*keys, "x", "y", "confidence", radius.alias("ring"), steps.alias("steps"), F.explode(F.sequence(F.lit(0), steps - 1)).alias("k"))
    at = at.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("by"))
    angle, far = F.col("k") / F.col("steps") * F.lit(2 * 3.141592653589793), F.col("ring") + F.col("by")
    put = lambda c, f: round_half_up(F.col(c) + f(angle) * far).cast("int")
    high, medium, other = (34, 197, 94), (14, 165, 233), (245, 158, 11)
    colour = [F.when(F.col("confidence") == "high", h).when(F.col("confidence") == "medium", m).otherwise(o).alias(c) for c, h, m, o in zip("rgb", high, medium, other)]
    return at.select(*keys, put("x", F.cos).alias("px"), put("y", F.sin).alias("py"), *colour).distinct()
