"""Connected components of masks, and what is measured on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphtally.operators.lineage import cut

#: Edges of a group that one task folds, and of all groups that it folds, or so.
FOLD = 200_000


def components(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """(image_id, y, x) of ink with ``label``: the least raster position of its component.

    Ink is gathered into runs along the rows by windows; runs that touch in adjacent rows are connected, and only runs go through rounds.
    """
    row = Window.partitionBy("image_id", "y").orderBy("x")
    starts = (F.col("x") != F.lag("x", 1).over(row) + 1) | F.lag("x", 1).over(row).isNull()
    ink = mask.select("image_id", "y", "x").withColumn("x0", F.max(F.when(starts, F.col("x"))).over(row.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut(ink.groupBy("image_id", "y", "x0").agg(F.max("x").alias("x1")).withColumn("spot", _spot(F.col("y"), F.col("x0"))))
    below = runs.select("image_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("spot").alias("other"))
    reach = 1 if diagonal else 0
    edges = runs.join(below, ["image_id", "y"]).where((F.col("x0") <= F.col("u1") + reach) & (F.col("x1") >= F.col("u0") - reach))
    heads = connected(edges.select("image_id", F.col("spot").alias("a"), F.col("other").alias("b")), "image_id")
    named = runs.join(heads, ["image_id", "spot"], "left").select("image_id", "spot", "x1", F.coalesce("head", "spot").alias("label"))
    return ink.withColumn("spot", _spot(F.col("y"), F.col("x0"))).join(named.drop("x1"), ["image_id", "spot"]).select("image_id", "y", "x", "label")


def _spot(y: Column, x: Column) -> Column:
    return y.cast("long") * F.lit(1 << 20) + x


def _folded(held: DataFrame, group: str, tasks: int) -> DataFrame:
    """`connected` of groups whose edges (group, n, m) each fit one task."""
    schema = held.select(group, F.col("n").alias("spot"), F.col("m").alias("head")).schema

    def fold(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        edges = pa.Table.from_batches(held).combine_chunks()
        names = edges["name"].combine_chunks().dictionary_encode().indices.to_numpy()
        spot = np.concatenate([edges["n"].to_numpy(), edges["m"].to_numpy()])
        key, row = np.concatenate([names, names]), np.tile(np.arange(len(names)), 2)
        order = np.lexsort((spot, key))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(spot[order]) != 0) | (np.diff(key[order]) != 0)
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(first) - 1
        a, b = node[:len(names)], node[len(names):]
        label = np.arange(first.sum())  # nodes are numbered by group and place, so the least label is the least place
        while (label[a] != label[b]).any():
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label = label[label]
        chosen = order[first]
        at, spots = pa.array(row[chosen]), spot[chosen]
        yield pa.RecordBatch.from_arrays([edges[group].combine_chunks().take(at), pa.array(spots), pa.array(spots[label])], names=[group, "spot", "head"])

    named = held.select(F.to_json(F.struct(group)).alias("name"), group, "n", "m")
    return named.repartition(tasks, "name").mapInArrow(fold, schema)


def connected(edges: DataFrame, group: str) -> DataFrame:
    """(group, spot, head): the least node reachable over the edges (group, a, b), for each node that has one.

    Groups with at most FOLD edges between whole numbers are folded, many in a task; the others, of any size, go through rounds.
    """
    held = cut(edges.select(group, F.greatest("a", "b").cast("long").alias("n"), F.least("a", "b").cast("long").alias("m")).where("n <> m").distinct())
    sizes = held.groupBy(group).agg(F.count("*").alias("edges"))
    most, total = sizes.agg(F.max("edges"), F.sum("edges")).first()
    tasks = max(1, -(-(total or 0) // FOLD))
    if (most or 0) <= FOLD:
        return _folded(held, group, tasks)
    large = cut(sizes.where(F.col("edges") > FOLD).select(group))
    return _folded(held.join(large, group, "left_anti"), group, tasks).union(_rounds(cut(held.join(large, group, "left_semi")), group))


def _rounds(held: DataFrame, group: str) -> DataFrame:
    """`connected` of edges (group, n, m), n above m, of any number.

    Every round hangs the larger neighbours of a node, then the node itself, on the least of them, until all edges lead to heads; their number
    falls with the logarithm of the longest path.
    """
    while True:
        both = held.union(held.select(group, "m", "n")).toDF(group, "n", "m")
        least = both.groupBy(group, "n").agg(F.least(F.col("n"), F.min("m")).alias("head"))
        large = both.where("m > n").join(least, [group, "n"]).select(group, F.col("m").alias("n"), F.col("head").alias("m"))
        least = large.groupBy(group, "n").agg(F.min("m").alias("head"), F.collect_set("m").alias("others"))
        # a node's own edge, and those that hang its other neighbours on its head
        ways = F.concat(F.array(F.struct(F.col("n").alias("n"), F.lit(False).alias("more"))), F.transform(F.array_remove("others", F.col("head")), lambda m: F.struct(m.alias("n"), F.lit(True).alias("more"))))
        held = cut(least.select(group, "head", F.explode(ways).alias("w")).select(group, "w.n", F.col("head").alias("m"), "w.more").groupBy(group, "n", "m").agg(F.max("more").alias("more")))
        loose = held.where("more").limit(1).count()
        held = held.drop("more")
        # done when every node hangs on one head that hangs on nothing
        if not loose and not held.join(held.select(group, F.col("n").alias("m")).distinct(), [group, "m"], "left_semi").limit(1).count():
            heads = held.select(group, F.col("m").alias("spot"), F.col("m").alias("head")).distinct()
            return held.toDF(group, "spot", "head").union(heads)


def measures(labelled: DataFrame) -> DataFrame:
    """Area, box, centre and central moments of each component, numbered by its first pixel."""
    m = labelled.groupBy("image_id", "label").agg(
        F.count("*").alias("area"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("mu20"), F.var_pop("y").alias("mu02"), F.covar_pop("x", "y").alias("mu11"))
    return m.withColumn("component", F.row_number().over(Window.partitionBy("image_id").orderBy("label"))).drop("label")


def _inner(px: DataFrame, ink: Column) -> DataFrame:
    """(image_id, y, x, label) of the 4-connected regions without ink that do not touch the border."""
    size = px.groupBy("image_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    empty = components(px.where(~ink), diagonal=False).join(size, "image_id")
    edge = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("h")) | (F.col("x") == F.col("w"))
    return empty.withColumn("edge", F.max(edge).over(Window.partitionBy("image_id", "label"))).where("NOT edge").select("image_id", "y", "x", "label")


def holes(px: DataFrame, ink: Column) -> DataFrame:
    """(image_id, holes): 4-connected regions without ink that do not touch the border."""
    inner = _inner(px, ink).groupBy("image_id").agg(F.count_distinct("label").alias("holes"))
    return px.select("image_id").distinct().join(inner, "image_id", "left").na.fill(0, ["holes"])


def attributed_holes(px: DataFrame, ink: Column) -> DataFrame:
    """(image_id, label, holes, hole_area) of the components of ink: a hole belongs to the ink beside its first pixel that has some, left, right, above, below."""
    own = cut(components(px.where(ink)))
    inner = _inner(px, ink).withColumnRenamed("label", "hole")
    sides = F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(((0, -1), (0, 1), (-1, 0), (1, 0)))])
    beside = inner.withColumn("s", F.explode(sides)).select("image_id", "hole", _spot(F.col("y"), F.col("x")).alias("at"), "s.turn", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    owner = beside.join(own, ["image_id", "y", "x"]).groupBy("image_id", "hole").agg(F.min(F.struct("at", "turn", "label"))["label"].alias("label"))
    area = inner.groupBy("image_id", "hole").agg(F.count("*").alias("area"))
    found = owner.join(area, ["image_id", "hole"]).groupBy("image_id", "label").agg(F.count("*").alias("holes"), F.sum("area").alias("hole_area"))
    return own.select("image_id", "label").distinct().join(found, ["image_id", "label"], "left").na.fill(0, ["holes", "hole_area"])


def ellipse(measured: DataFrame) -> DataFrame:
    """``measured`` with the semi-axes of the ellipse of its second moments, and their ratio as circularity."""
    bend = F.sqrt(F.pow(F.col("mu20") - F.col("mu02"), F.lit(2)) + 4 * F.col("mu11") * F.col("mu11"))
    axis = lambda v: F.sqrt(F.greatest(F.lit(1e-9), 2 * v))
    out = measured.withColumn("major", axis(F.col("mu20") + F.col("mu02") + bend)).withColumn("minor", axis(F.col("mu20") + F.col("mu02") - bend))
    return out.withColumn("circularity", F.col("minor") / F.col("major"))
