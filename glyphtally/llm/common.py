"""Shared helpers: scratch tables, bounded id filters, connected components, text hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number of cells of an id filter. Its broadcast has at most so many longs, whatever the input.
FILTER_CELLS = 1 << 20
#: Bytes of one Arrow batch of texts, about.
BATCH_BYTES = 4 << 20


class Scratch:
    """A folder for written intermediate tables, in the shared folder of ``spark.checkpoint.dir``.

    Tables are cut from their lineage by being written and read again, so a lost executor
    costs no recomputation. Only a local master may leave the setting unset: one process then sees
    the temporary folder that is made. On a cluster that is an error, as executors share no local folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="spark-scratch-")
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        where = self.path(name)
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch hold much more than BATCH_BYTES: texts may be long, and a worker holds a batch several times over."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(setting, f"{BATCH_BYTES}b")


def tidy(run):
    """A ``mapInPandas`` function that gives freed memory back when its task ends, since Python workers live on between tasks."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Return what the allocators of this process hold unused to the system, where they can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library: it keeps its free pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_in(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose key may be among ``ids``: all that are, and a few that are not.

    The keys are hashed to FILTER_CELLS cells and only the distinct cells are broadcast, so the
    broadcast is bounded; no row of ``df`` is shuffled. An exact join follows where it matters.
    """
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_CELLS))
    cells = ids.select(cell(F.col(id_col)).alias("__cell")).distinct()
    return df.withColumn("__cell", cell(F.col(key))).join(F.broadcast(cells), "__cell", "left_semi").drop("__cell")


def without_ids(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``. Rows that surely stay are not shuffled."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_CELLS))
    ids = ids.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct()
    cells = ids.select(cell(F.col("__id")).alias("__cell")).distinct()
    marked = df.withColumn("__cell", cell(F.col(key)))
    sure = marked.join(F.broadcast(cells), "__cell", "left_anti").drop("__cell")
    rest = marked.join(F.broadcast(cells), "__cell", "left_semi").drop("__cell")
    rest = rest.join(ids, rest[key] == ids["__id"], "left_anti")
    return sure.unionByName(rest)


def connected(scratch: Scratch, edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for each node that has one.

    Alternating large-star and small-star rounds; each round is a grouped minimum and a join back,
    written to scratch. Edges never reach the driver, only a count and a checksum do.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m").distinct()
    e = scratch.write(e, f"{name}-0")
    seen, k = None, 0
    while True:
        state = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, m))")).first()
        if tuple(state) == seen or not state[0]:
            break
        seen, k = tuple(state), k + 1
        both = e.union(e.select("m", "v")).toDF("u", "w")
        low = both.groupBy("u").agg(F.min("w").alias("w0")).select("u", F.least("u", "w0").alias("m"))
        large = both.where("w > u").join(low, "u").select(F.col("w").alias("v"), "m").distinct()
        large = scratch.write(large, f"{name}-{k}a")
        lows = large.groupBy("v").agg(F.min("m").alias("m0"))
        small = lows.select("v", F.col("m0").alias("m")).union(
            large.join(lows, "v").where("m <> m0").select(F.col("m").alias("v"), F.col("m0").alias("m"))
        )
        e = scratch.write(small.distinct(), f"{name}-{k}b")
    stars = e.groupBy("v").agg(F.min("m").alias("m"))
    return stars.union(e.select(F.col("m").alias("v"), "m").distinct()).toDF("node", "component").distinct()


# --- hashing of words, in numpy over whole batches -------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240229))
CASED = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = CASED.copy()
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = CASED[_SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list, size: int = 1 << 18, most: int = 4096):
    """Index ranges of about ``size`` characters and at most ``most`` texts, so that numpy's temporaries stay small."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > size or i - start == most:
            yield start, i
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list, bytes_as: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` and each text's word bounds. A-Z are lower-cased unless bytes are read as CASED."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    word = ~_SPACE[buf]
    starts = np.flatnonzero(word & np.concatenate(([True], ~word[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    spans = np.diff(np.append(starts, len(buf)))
    place = np.arange(len(buf) - starts[0]) - np.repeat(starts - starts[0], spans)
    powers = np.cumprod(np.full(int(spans.max()) + 1, _STEP | np.uint64(1), np.uint64))
    h = mix64(np.add.reduceat(bytes_as[buf[starts[0]:]] * powers[place], starts - starts[0]))
    return h, np.concatenate(([0], np.searchsorted(starts, ends)))


def shingle_sets(texts: list, width: int = 5):
    """For each text the sorted distinct 64-bit hashes of its word shingles.

    A text with 1 to width-1 words has one shingle, the whole sequence; one without words has none.
    """
    for lo, hi in chunks(texts):
        h, bounds = word_hashes(texts[lo:hi])
        n = len(h) - width + 1
        rolled = sum((h[k:k + n] * _PLACE[k] for k in range(1, width)), h[:n] * _PLACE[0]) if n > 0 else h[:0]
        rolled = mix64(rolled)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= width:
                s = np.sort(rolled[a:b - width + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield mix64((h[a:b] * _PLACE[:b - a]).sum(keepdims=True) + _PLACE[40 + b - a:41 + b - a])
            else:
                yield h[:0]
