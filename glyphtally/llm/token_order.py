"""Token ids in training order, as fixed-stride binary shards.

Every document is tokenised whole, closed by an end token, and cut into sequences of ``length`` ids, the last
padded with the end token. Sequences get dense numbers 0..N-1 in the order in which the table is read; a
keyed Feistel network over the next power of four, walked along its cycle until it falls below N, maps
each number to its global slot: a seeded shuffle that needs no sort and can be computed, or
inverted, for any sequence alone. Slot s stands in shard s // per_shard at byte
(s % per_shard) * 2 * length, so a reader can start, stop and resume anywhere.

Sequences go to the writers in range partitions of consecutive shards, one piece per group of documents and range. What travels is the tokens, and once per piece
the documents they are of; a writer finds the numbers and slots of its sequences by the inverse permutation.

Nulls and empty texts: one sequence of end tokens, 0 tokens of text. Repeated rows, and rows with equal ids, have sequences of
their own. An empty table gives no rows and no files. Rows with a null id keep it and leave other ids as they are. Very long texts are
tokenised whole and have as many sequences as they need. Ties cannot arise: slots are a permutation. Only the id and the text are looked at.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, mix64, tidy

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's byte-level BPE splits text before merging: a fixed value of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: Documents, or tokens, that are compressed and dealt out together, about.
GROUP, GROUP_TOKENS = 4000, 1 << 22
#: Consecutive shards that a task holds and writes at once, at most.
RANGE = 8
#: Tasks of the first pass whose beginnings are broadcast, at most.
BROADCAST = 1_000_000


class Tokens:
    """Whole-text encoder."""

    def __init__(self, vocabulary: str):
        import tiktoken

        if not os.path.exists(vocabulary):
            raise FileNotFoundError(f"{vocabulary}: every executor needs the vocabulary at the path given as `vocabulary`")
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None) -> np.ndarray:
        return np.array(self.encode(text) if text else [], "<u2")


def _tokenised(vocabulary: str, length: int):
    """Groups of documents: their ids, token counts and tokens, and how many sequences of the task come before them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tokens, squeeze, ahead, task = Tokens(vocabulary), zstandard.ZstdCompressor(level=9), 0, TaskContext.get().partitionId()
        ids, nones, own, size = [], [], [], 0

        def group() -> pd.DataFrame:
            return pd.DataFrame({
                "task": [task], "ahead": [ahead], "held": [sum(len(x) // length + 1 for x in own)], "ids": [ids], "none": [nones],
                "ns": [[len(x) for x in own]], "data": [squeeze.compress(np.concatenate(own).tobytes())]})

        for pdf in batches:
            for i, none, text in zip(pdf["id"].tolist(), pdf["none"], pdf["text"]):
                ids.append(i), nones.append(none), own.append(tokens(text))
                size += len(own[-1])
                if len(own) >= GROUP or size >= GROUP_TOKENS:
                    yield (out := group())
                    ahead += int(out["held"].iloc[0])
                    ids, nones, own, size = [], [], [], 0
        if own:
            yield group()

    return run


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1 or its inverse, by cycle-walking a Feistel network over the next power of four."""
    half = np.uint64(max(1, (max(2, n) - 1).bit_length() + 1 >> 1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out, walking = x.astype(np.uint64), np.arange(len(x))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys[::-1] if inverse else keys:
            left, right = (right ^ (mix64(left + k) & mask), left) if inverse else (right, left ^ (mix64(right + k) & mask))
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def slot_of(number: Column | str, n: int, key: int) -> Column:
    @F.pandas_udf("long")
    def slot(s: pd.Series) -> pd.Series:
        return pd.Series(feistel(s.to_numpy(), n, key))

    return slot(number)


def _sequences(length: int, per_range: int, n: int, key: int):
    """The sequences of a group, one row per range of slots that gets any: their records by number, and their documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loosen, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=9)
        for pdf in batches:
            for first, ids, none, ns, data in zip(pdf["first"], pdf["ids"], pdf["none"], pdf["ns"], pdf["data"]):
                ids, none, ns = (np.asarray(x, np.int64) for x in (ids, none, ns))
                parts, flat, at = ns // length + 1, np.frombuffer(loosen.decompress(data), "<u2"), 0
                records, start = np.full((int(parts.sum()), length), END, "<u2"), np.cumsum(parts) - parts
                for k, count in zip(start, ns):
                    records.reshape(-1)[k * length:k * length + count] = flat[at:at + count]
                    at += count
                doc = np.repeat(np.arange(len(ns)), parts)
                span = feistel(first + np.arange(len(doc)), n, key) // per_range
                order = np.argsort(span, kind="stable")
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(span[order])) + 1, [len(span)]))
                own = [order[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:])]
                docs = [np.unique(doc[k]) for k in own]
                yield pd.DataFrame({
                    "span": span[order[cuts[:-1]]], "first": first, "held": len(doc),
                    "docs": [squeeze.compress(np.stack([ids[d], none[d], first + start[d], ns[d]]).tobytes()) for d in docs],
                    "data": [squeeze.compress(records[k].tobytes()) for k in own]})

    return run


def _written(root: str, length: int, per_shard: int, per_range: int, n: int, key: int):
    """Write the shards of each range of a sorted partition; a file appears under its name only when whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(root)
        task, loosen, held, span = TaskContext.get().taskAttemptId(), zstandard.ZstdDecompressor(), [], None

        def written() -> Iterator[pd.DataFrame]:
            start = span * per_range
            slots = np.arange(start, min(n, start + per_range))
            numbers = feistel(slots, n, key, inverse=True)
            order = np.argsort(numbers)
            records = np.empty((len(slots), length), "<u2")
            for first, count, docs, data in held:
                own = order[slice(*np.searchsorted(numbers[order], (first, first + count)))]
                records[own] = np.frombuffer(loosen.decompress(data), "<u2").reshape(-1, length)
                ids, none, begin, ns = np.frombuffer(loosen.decompress(docs), np.int64).reshape(4, -1)
                doc = np.searchsorted(begin, numbers[own], side="right") - 1
                place = numbers[own] - begin[doc]
                yield pd.DataFrame({
                    "id": pd.arrays.IntegerArray(ids[doc], none[doc] > 0), "place": place, "sequence": numbers[own], "slot": slots[own], "shard": slots[own] // per_shard,
                    "byte_offset": slots[own] % per_shard * 2 * length, "n_tokens": np.clip(ns[doc] - place * length, 0, length), "crc32": [zlib.crc32(records[k].tobytes()) for k in own]})
            for lo in range(0, len(slots), per_shard):
                shard = (start + lo) // per_shard
                with store.open_output_stream(f"{base}/_{shard:08d}.{task}") as f:
                    f.write(records[lo:lo + per_shard].tobytes())
                store.move(f"{base}/_{shard:08d}.{task}", f"{base}/{shard:08d}.bin")
            held.clear()

        for pdf in batches:
            for row in zip(pdf["span"], pdf["first"], pdf["held"], pdf["docs"], pdf["data"]):
                if held and row[0] != span:
                    yield from written()
                span = row[0]
                held.append(row[1:])
        if held:
            yield from written()

    return run


def materialise_training_order(
    spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", root: str | None = None, length: int = 128,
    per_shard: int = 1 << 14, key: int = 20240229, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the shards under ``root`` (a URI all executors reach) and return one row per sequence:
    id, place in the document, sequence, slot, shard, byte_offset, n_tokens, crc32 of the record."""
    from pyarrow import fs

    bounded_batches(spark)
    scratch = Scratch(spark, "token-order")
    own = F.col(id_col).cast("long")
    docs = df.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("none"), F.col(text_col).alias("text"))
    tokens = docs.mapInPandas(tidy(_tokenised(vocabulary, length)), "task int, ahead long, held long, ids array<long>, none array<boolean>, ns array<int>, data binary")
    tokens.write.option("compression", "none").parquet(scratch.path("tokens"))
    tokens = spark.read.schema(tokens.schema).parquet(scratch.path("tokens"))

    # dense numbers: one row per task of the first pass says where its numbers begin
    tasks = tokens.groupBy("task").agg(F.sum("held").alias("own"))
    total, made = tasks.agg(F.coalesce(F.sum("own"), F.lit(0)), F.count("*")).first()
    ahead = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("own").over(ahead), F.lit(0)).alias("before"))
    groups = tokens.join(F.broadcast(tasks) if made <= BROADCAST else tasks, "task").select((F.col("before") + F.col("ahead")).alias("first"), "ids", "none", "ns", "data")

    shards = max(1, -(-total // per_shard))
    per_range = per_shard * max(1, min(RANGE, shards // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = groups.mapInPandas(tidy(_sequences(length, per_range, total, key)), "span long, first long, held long, docs binary, data binary")
    root = root or scratch.path("shards")
    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base)
    dealt = rows.repartitionById(max(1, -(-total // per_range)), F.col("span").cast("int")).sortWithinPartitions("span")
    out = dealt.mapInPandas(tidy(_written(root, length, per_shard, per_range, total, key)), "id long, place long, sequence long, slot long, shard long, byte_offset long, n_tokens long, crc32 long")
    return out.withColumnRenamed("id", id_col)


def read_slots(root: str, length: int, per_shard: int, first: int, count: int) -> np.ndarray:
    """[slot, token] of ``count`` slots from ``first`` on, read from the shards in order."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    out = []
    while count > 0:
        shard, at = divmod(first, per_shard)
        take = min(count, per_shard - at)
        with store.open_input_file(f"{base}/{shard:08d}.bin") as f:
            f.seek(at * 2 * length)
            out.append(np.frombuffer(f.read(take * 2 * length), "<u2").reshape(-1, length))
        first, count = first + take, count - take
    return np.concatenate(out) if out else np.zeros((0, length), "<u2")
