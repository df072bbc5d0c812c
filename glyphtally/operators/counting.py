"""Counts, queues, corrections, evaluation and exports over markers.

A marker row has: image_id, marker_id, final_number, manual_number, confidence, score, rejected, needs_review,
x, y, radius, shape_group, method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtally import settings as S
from glyphtally.functions.numeric import csv_field, plain_number


def value() -> Column:
    return F.coalesce("manual_number", "final_number")


def count_summary(markers: DataFrame, by: str) -> DataFrame:
    """One row per image: total of named markers and the four tallies."""
    live, manual = ~F.col("rejected"), F.col("manual_number").isNotNull()
    high = live & (manual | (F.col("confidence") == "high"))
    medium = live & ~manual & (F.col("confidence") == "medium")
    return markers.groupBy(by).agg(
        F.count_if(live & value().isNotNull()).alias("total"), F.count_if(high).alias("high"), F.count_if(medium).alias("medium"),
        F.count_if(live & ~F.coalesce(high, F.lit(False)) & ~F.coalesce(medium, F.lit(False))).alias("review"), F.count_if("rejected").alias("rejected"))


def count_rows(markers: DataFrame, by: str, dense: bool = False) -> DataFrame:
    """(by, number, count), with zeros for 1 to 10 if ``dense``."""
    counts = markers.where(~F.col("rejected") & value().isNotNull()).groupBy(by, value().alias("number")).agg(F.count("*").alias("count"))
    if not dense:
        return counts
    grid = markers.select(by).distinct().withColumn("number", F.explode(F.array(*[F.lit(n) for n in S.SUPPORTED_NUMBERS])))
    return grid.join(counts, [by, "number"], "left").na.fill(0, ["count"])


def count_text(markers: DataFrame, by: str) -> DataFrame:
    """(by, text): '1: 163, 2: 284'."""
    rows = count_rows(markers, by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("number", "count"))).alias("rows"))
    return rows.select(by, F.array_join(F.transform("rows", lambda r: F.concat_ws(": ", r["number"], r["count"])), ", ").alias("text"))


def confidence_histogram(df: DataFrame, by: str, confidence: str, weight: Column) -> DataFrame:
    """(by, bin, weight) for ten bins, zeros included."""
    bin_ = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col(confidence) * 10))).cast("int")
    sums = df.groupBy(by, bin_.alias("bin")).agg(F.sum(weight).alias("weight"))
    grid = df.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return grid.join(sums, [by, "bin"], "left").na.fill(0, ["weight"])


def review_queue(markers: DataFrame, by: str) -> DataFrame:
    """Markers to look at, numbered worst first per image: unnamed ones lose one point."""
    open_ = markers.where(~F.col("rejected") & F.col("manual_number").isNull() & (F.col("needs_review") | F.col("final_number").isNull()))
    priority = F.coalesce("score", F.lit(0.0)) + F.when(F.col("final_number").isNull(), -1.0).otherwise(0.0)
    return open_.withColumn("priority", priority).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("priority", "marker_id")))


def fold_corrections(log: DataFrame, key: list[str], order: str, fields: list[str]) -> DataFrame:
    """The last correction of each key."""
    last = log.groupBy(*key).agg(F.max(F.struct(F.col(order).alias("__order"), *fields)).alias("last"), F.count("*").alias("corrections"))
    return last.select(*key, *[F.col(f"last.{f}").alias(f) for f in fields], "corrections")


def apply_group_corrections(markers: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Relabel or reject whole groups: ``groups`` (group, new_number, reject). Rejecting takes every member; naming leaves rejected ones alone."""
    met = markers.join(groups, group, "left")
    reject = F.coalesce("reject", F.lit(False))
    named = F.col("new_number").isNotNull() & ~F.col("rejected") & ~reject
    return met.withColumn("manual_number", F.when(named, F.col("new_number")).otherwise(F.col("manual_number"))).withColumn("rejected", F.col("rejected") | reject).drop("new_number", "reject")


def newest(df: DataFrame, by: str, at: str, keep: int = S.SAVED_IMAGES, tie: str | None = None) -> DataFrame:
    """The newest ``keep`` rows of each key."""
    order = [F.desc(at), *([F.desc(tie)] if tie else [])]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= keep)


def accuracy(expected: Column, found: Column) -> Column:
    exact = F.when(found == 0, 1.0).otherwise(0.0)
    return F.when(expected == 0, exact).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(found - expected) / F.greatest(expected, F.lit(1))))


def evaluate(truth: DataFrame, counts: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Per number and per image: (by, number, expected, detected, difference, accuracy) and the totals."""
    both = truth.join(counts, [by, "number"], "full_outer").na.fill(0, ["expected", "detected"])
    rows = both.withColumn("difference", F.col("detected") - F.col("expected")).withColumn("accuracy", accuracy(F.col("expected"), F.col("detected")))
    total = rows.groupBy(by).agg(
        F.sum("expected").alias("expected"), F.sum("detected").alias("detected"), F.sum("difference").alias("difference"),
        F.sum(F.greatest("difference", F.lit(0))).alias("over"), F.sum(F.greatest(-F.col("difference"), F.lit(0))).alias("under"))
    total = total.select(
        by, "expected", "detected", "difference", accuracy(F.col("expected"), F.col("detected")).alias("accuracy"),
        F.greatest(F.lit(0), -F.col("difference")).alias("missed"), F.greatest(F.lit(0), F.col("difference")).alias("extra"), F.least("over", "under").alias("misclassified_at_least"))
    return rows, total


def format_evaluation(rows: DataFrame, by: str) -> DataFrame:
    """(by, number, line): one padded line per number."""
    line = F.format_string("    %2d: expected %4d detected %4d (%s, %.1f%%)", "number", "expected", "detected", F.concat(F.when(F.col("difference") >= 0, "+").otherwise(""), F.col("difference").cast("string")), F.round(F.col("accuracy") * 100, 1))
    return rows.select(by, "number", line.alias("line"))


def purity(members: DataFrame, group: str, truth: str) -> DataFrame:
    """(group, members, majority, purity, named_right): the most frequent true number of a group, the smaller on ties."""
    counts = members.groupBy(group, truth).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.max(F.struct("n", (-F.col(truth)).alias("t"))).alias("b"), F.sum("n").alias("members"))
    return best.select(group, "members", (-F.col("b.t")).alias("majority"), (F.col("b.n") / F.col("members")).alias("purity"), (-F.col("b.t") == F.col(group)).alias("named_right"))


def shown(markers: DataFrame, level: str | None = None, numbers: list[int] | None = None) -> DataFrame:
    """What an overlay shows: manual markers pass the level filter, but not the number filter; with the colour key."""
    out = markers
    if level:
        out = out.where(F.col("manual_number").isNotNull() | (F.col("confidence") == level))
    if numbers:
        out = out.where(value().isin(list(numbers)))
    key = (F.when(F.col("rejected"), "rejected").when(F.col("manual_number").isNotNull(), "manual").when(F.col("confidence") == "review", "review")
           .when(F.col("confidence") == "high", "high").otherwise("medium"))
    return out.withColumn("colour_key", key)


CSV_FIELDS = ["marker_id", "number", "x", "y", "radius", "confidence", "confidence_score", "ocr_result", "ocr_confidence", "shape_group", "classification_method", "review_status"]


def csv_lines(markers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line): the export line of each marker, in the order of CSV_FIELDS."""
    status = F.when(F.col("rejected"), "not-a-marker").when(F.col("needs_review"), "needs-review").otherwise("accepted")
    text = lambda c: c.cast("string")
    fields = [
        F.col("marker_id").cast("string"), text(value()), plain_number(F.col("x"), 1), plain_number(F.col("y"), 1), plain_number(F.col("radius"), 1),
        F.when(F.col("rejected"), "rejected").otherwise(F.col("confidence")), plain_number(F.col("score"), 3), F.lit(""), F.lit(""),
        F.when(F.col("shape_group") >= 0, text(F.col("shape_group"))), F.col("method"), status]
    return markers.select(*keys, F.concat_ws(",", *[csv_field(f) for f in fields]).alias("line"))


def _sorted_counts(markers: DataFrame, by: str) -> DataFrame:
    """(by, counts, total): the counts as a map by number, in the order of the numbers."""
    in_order = F.array_sort(F.collect_list(F.struct("number", "count")))
    entries = F.transform(in_order, lambda e: F.struct(e["number"].cast("string").alias("key"), e["count"].alias("value")))
    return count_rows(markers, by).groupBy(by).agg(F.map_from_entries(entries).alias("counts"), F.sum("count").alias("total"))


def json_documents(markers: DataFrame, by: str) -> DataFrame:
    """(by, json): version, summary with counts, and the marker list of each image."""
    row = F.struct(
        F.col("marker_id").alias("__order"), F.col("marker_id").cast("string").alias("id"), "x", "y", "radius", value().alias("number"),
        F.when(F.col("rejected"), "rejected").otherwise(F.col("confidence")).alias("confidence"), "method", "rejected")
    listed = markers.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(row)), lambda m: m.dropFields("__order")).alias("markers"))
    met = listed.join(_sorted_counts(markers, by).select(by, "counts"), by, "left").join(count_summary(markers, by), by)
    empty = F.create_map().cast("map<string,bigint>")
    summary = F.struct("total", F.coalesce("counts", empty).alias("counts"), "high", "medium", "review", "rejected")
    return met.select(by, F.to_json(F.struct(F.lit(1).alias("version"), summary.alias("summary"), "markers")).alias("json"))


def truth_documents(markers: DataFrame, by: str) -> DataFrame:
    """(image, counts, total, notes) rows that the truth reader reads back; the counts stand in the order of the numbers."""
    return _sorted_counts(markers, by).withColumnRenamed(by, "image").withColumn("notes", F.lit("Verified by hand."))


def truth_text() -> Column:
    """The file of a row of `truth_documents`."""
    return F.to_json(F.struct(F.col("image").cast("string").alias("image"), "counts", "total", "notes"))


def apply_corrections(markers: DataFrame, last: DataFrame) -> DataFrame:
    """Markers with the last correction (image_id, marker_id, number, reject) of each: a rejection, or a number that also takes a rejection back."""
    met = markers.join(last.select("image_id", "marker_id", F.col("number").alias("__number"), "reject"), ["image_id", "marker_id"], "left")
    set_ = F.col("reject").isNotNull() & ~F.col("reject")
    return met.withColumn("manual_number", F.when(set_, F.col("__number")).otherwise(F.col("manual_number"))).withColumn("rejected", F.coalesce("reject", "rejected")).drop("__number", "reject")


def saved_for(images: DataFrame, saved: DataFrame, by: str, what: str) -> DataFrame:
    """(by, saved): what is saved of each image, in order, an empty list where nothing is."""
    lists = saved.groupBy(by).agg(F.array_sort(F.collect_list(what)).alias("saved"))
    return images.join(lists, by, "left").withColumn("saved", F.coalesce("saved", F.array().cast(saved.select(F.array(what)).schema[0].dataType)))
