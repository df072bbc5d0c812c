"""Embedding near-duplicates by E8 lattice hashing.

Each table projects the unit vectors to blocks of eight random directions, scales them and decodes every block to the
nearest point of the E8 lattice; the points are the cell. Every vector stands in its own
cell and asks in the cells that its nearest neighbouring lattice points give. Pairs that meet are
verified by their cosine in double precision, so none below the limit is linked.

Equal vectors are one class. Cells with many vectors are dealt out in blocks, and a pair that meets in the
own cells of several tables is reported by the first.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do
vectors of different lengths with each other, and vectors without id, which leave other rows as they are. Repeated ids are separate vectors with one id: classes are told apart by
their content, and ids only name them. An empty table gives no rows.
Ties: a cosine of exactly the limit links; of equal vectors, and in a component, the smallest id names it. Only the id and the vector are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, connected, mix64, tidy

TABLES = 10
BLOCKS = 2
#: Lattice units per unit of projected length.
SCALE = 0.6
PROBES = 8
#: Vectors of one cell that a task compares with those that ask.
CELL_BLOCK = 2000
#: Rows of cells that are compared many at a time; larger ones go through matrix products of their own.
SMALL = 64


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [v for i in range(8) for j in range(i) for a, b in product((1, -1), repeat=2) for v in [np.eye(8)[i] * a + np.eye(8)[j] * b]]
    half = [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


ROOTS = _roots()


def _decode_d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    if len(odd):
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of each row."""
    a, b = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _key(table: int, points: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(points[0]), table + 1, np.uint64)
    for p in points:
        for c in np.rint(2 * p).astype(np.int64).T:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c.view(np.uint64))
    return h


def unit_rows(vectors) -> np.ndarray:
    x = np.vstack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(x: np.ndarray, probes: int = PROBES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per table the own cell and, [vector, probe], the neighbouring cells of unit rows."""
    for t in range(TABLES):
        y = SCALE * x @ np.random.default_rng([t, x.shape[1]]).standard_normal((x.shape[1], 8 * BLOCKS))
        own, near = [], []
        for b in range(BLOCKS):
            z = y[:, 8 * b:8 * b + 8]
            p = decode_e8(z)
            gap = z - p
            cost = 2 - 2 * gap @ ROOTS.T  # growth of the squared distance when stepping to a neighbour
            best = np.argsort(cost, 1, kind="stable")[:, :4]
            own.append(p)
            near.append((np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(cost, best, 1)], 1), np.concatenate([p[:, None], p[:, None] + ROOTS[best]], 1)))
        total = sum(np.expand_dims(near[b][0], tuple(1 + k for k in range(BLOCKS) if k != b)) for b in range(BLOCKS)).reshape(len(x), -1)
        chosen = np.argsort(total, 1, kind="stable")[:, 1:probes + 1]
        steps = np.unravel_index(chosen, (5,) * BLOCKS)
        asked = np.stack([_key(t, [np.take_along_axis(near[b][1], steps[b][:, k, None, None], 1)[:, 0] for b in range(BLOCKS)]) for k in range(chosen.shape[1])], 1)
        yield _key(t, own), asked


def _by_length(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = pdf["v"].map(len).to_numpy()
    for n in np.unique(lengths):
        part = pdf[lengths == n]
        for lo in range(0, len(part), 4096):
            yield part["id"].to_numpy()[lo:lo + 4096], unit_rows(part["v"].iloc[lo:lo + 4096])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for ids, x in _by_length(pdf):
            for own, asked in cells(x):
                yield pd.DataFrame({"cell": own.view(np.int64), "id": ids, "own": True})
                yield pd.DataFrame({"cell": asked.ravel().view(np.int64), "id": np.repeat(ids, asked.shape[1]), "own": False})


def _with_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for ids, x in _by_length(pdf):
            keys = np.stack([own for own, _ in cells(x, 1)], 1).view(np.int64)
            yield pd.DataFrame({"id": ids, "unit": [r.tobytes() for r in x], "cells": list(keys)})


def _linked(limit: float):
    """Pairs that reach the limit in the cells of a sorted partition."""

    def pairs(g: pd.DataFrame) -> pd.DataFrame | None:
        own = g["own"].to_numpy()
        if not own.any():
            return None
        ids, out = g["id"].to_numpy(), []
        keys = np.vstack(g["cells"].to_numpy())
        lengths = g["unit"].map(len).to_numpy()
        for n in np.unique(lengths):
            mine = np.flatnonzero(own & (lengths == n))
            all_ = np.flatnonzero(lengths == n)
            if not len(mine) or len(all_) < 2:
                continue
            x = np.frombuffer(b"".join(g["unit"].iloc[all_]), np.float64).reshape(len(all_), -1)
            at = np.searchsorted(all_, mine)
            for lo in range(0, len(all_), 2048):
                close = x[lo:lo + 2048] @ x[at].T >= limit
                q, p = np.nonzero(close)
                q, p = all_[q + lo], mine[p]
                keep = ids[q] != ids[p]
                q, p = q[keep], p[keep]
                met = keys[q] == keys[p]
                here = g["cell"].iloc[0]
                first = ~met.any(1) | (keys[q, met.argmax(1)] == here)
                out.append(np.stack([np.minimum(ids[q], ids[p]), np.maximum(ids[q], ids[p])], 1)[first])
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"]) if out else None

    def small(g: pd.DataFrame, lo: np.ndarray, size: np.ndarray) -> pd.DataFrame:
        """As ``pairs``, of many small cells (first row, rows) of ``g`` at once: each own row with every row of its cell."""
        ids, own, cell = g["id"].to_numpy(), g["own"].to_numpy(), g["cell"].to_numpy()
        x, keys = np.frombuffer(b"".join(g["unit"]), np.float64).reshape(len(g), -1), np.vstack(g["cells"].to_numpy())
        start, count = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        rows = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start[rows], count[rows] = np.repeat(lo, size), np.repeat(size, size)
        mine, out = np.flatnonzero(own & (count > 1)), []
        for part in np.array_split(mine, max(1, int(count[mine].sum()) >> 15)):
            n = count[part]
            p = np.repeat(part, n)
            q = np.repeat(start[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            near = (ids[p] != ids[q]) & (np.einsum("ij,ij->i", x[p], x[q]) >= limit)
            p, q = p[near], q[near]
            met = keys[q] == keys[p]
            first = ~met.any(1) | (keys[q, met.argmax(1)] == cell[p])
            out.append(np.stack([np.minimum(ids[q], ids[p]), np.maximum(ids[q], ids[p])], 1)[first])
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])

    def searched(pdf: pd.DataFrame, cuts: np.ndarray) -> Iterator[pd.DataFrame]:
        lo, size = cuts[:-1], np.diff(cuts)
        many = (size > 1) & (size <= SMALL) & (pdf["unit"].map(len).nunique() == 1)
        if many.any():
            yield small(pdf, lo[many], size[many])
        for k in np.flatnonzero((size > 1) & ~many):
            if (found := pairs(pdf.iloc[lo[k]:lo[k] + size[k]])) is not None:
                yield found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            cell, block = pdf["cell"].to_numpy(), pdf["block"].to_numpy()
            cuts = np.append(0, np.flatnonzero((cell[1:] != cell[:-1]) | (block[1:] != block[:-1])) + 1)
            yield from searched(pdf, cuts)
            rest = pdf.iloc[cuts[-1]:].reset_index(drop=True)
        if rest is not None and len(rest) > 1:
            yield from searched(rest, np.array([0, len(rest)]))

    return run


def near_duplicate_vectors(spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    bounded_batches(spark)
    scratch = Scratch(spark, "lattice")
    v = F.col(vector_col).cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    key = F.col(id_col).cast("long")
    rows = df.select(key.alias("vid"), F.when(F.coalesce(sound, F.lit(False)) & key.isNotNull(), v).alias("v"))
    rows = rows.withColumn("ha", F.xxhash64("v")).withColumn("hb", F.hash("v"))
    classes = rows.where("v IS NOT NULL").groupBy("ha", "hb").agg(F.min("vid").alias("id"), F.count("*").alias("copies"), F.min("v").alias("v"))
    # a class is known by its id, or, where different vectors share that, by its content
    shared = classes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("shared"))
    node = F.when(F.col("shared"), F.xxhash64("ha", "hb", F.lit(1))).otherwise(F.col("name"))
    classes = classes.join(shared, "id", "left").withColumnRenamed("id", "name").withColumn("id", node).drop("shared")
    classes = scratch.write(classes, "classes")

    dealt = classes.select("id", "v").repartition(F.col("id"))  # a small table in few files: let every core hash
    asked = scratch.write(dealt.mapInPandas(tidy(_hashed), "cell long, id long, own boolean"), "asked")
    met = asked.groupBy("cell").agg(F.count_if("own").alias("held"), F.min("id").alias("i"), F.max("id").alias("j")).where("held > 0 AND i < j")
    asked = asked.join(met.select("cell", "held"), "cell").dropDuplicates(["cell", "id", "own"])
    blocks = F.ceil(F.col("held") / F.lit(CELL_BLOCK)).cast("int")
    mine = asked.where("own").withColumn("block", F.pmod(F.hash("id"), blocks))
    split = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).where(~F.col("own") | (F.pmod(F.hash("id"), blocks) != F.col("block")))
    split = split.withColumn("own", F.lit(False)).unionByName(mine)
    units = scratch.write(dealt.mapInPandas(tidy(_with_cells), "id long, unit binary, cells array<long>"), "units")
    split = split.join(units, "id").repartition("cell", "block").sortWithinPartitions("cell", "block")
    links = split.select("cell", "block", "id", "own", "unit", "cells").mapInPandas(tidy(_linked(limit)), "a long, b long").distinct()
    links = scratch.write(links, "links")

    comps = scratch.write(connected(scratch, links, "a", "b", "comp").toDF("id", "node"), "comps")
    names = comps.join(classes.select("id", "name"), "id").groupBy("node").agg(F.min("name").alias("component"))
    comps = comps.join(names, "node").select("id", "component")
    sizes = classes.select("id", "copies")
    ends = links.union(links.select("b", "a")).toDF("id", "other").join(sizes.toDF("other", "more"), "other")
    more = ends.groupBy("id").agg(F.sum("more").alias("more"))
    out = classes.select("ha", "hb", "id", "name", "copies").join(more, "id", "left").join(comps, "id", "left")
    out = rows.select("vid", F.when(F.col("v").isNotNull(), F.col("ha")).alias("ha"), "hb").join(out, ["ha", "hb"], "left")
    component = F.coalesce("component", "name", "vid")
    return out.select(
        F.col("vid").alias(id_col), (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("vid") == component).alias("kept"))
