"""Ranked lexical search of many queries at once, by common subexpressions.

A document's score for an item is a sum over the item's terms, so items that share terms share partial sums. The term sets that
several items share are mined first: terms that always occur together are one node, then the pair of nodes that most items hold
becomes a node of its own, again and again. Nodes form a directed acyclic graph with terms as leaves and items as ends. For a batch of
documents the accumulator of each node is made once, from those of its two parts, and whatever holds the node reads it.

Documents are read twice. The first pass cuts whole texts into terms and keeps the counts of the terms that any item has; document
counts follow from it by a grouped sum. The second pass runs the graph over the kept counts; a task hands on its best
``top`` documents of each item, and two ranked windows (by item and group of tasks, then by item) leave the best of all, so no task
gets more than a bounded number of rows an item.

Items are a stated query set: they come in blocks of at most about BLOCK_TERMS terms, whose graph goes to all tasks; each block is
a pass over all documents. All numbers are 64-bit integers but the logarithm.

Nulls: null or empty texts have no terms; such documents match nothing and count for nothing, such items have no rows. Documents
without id rank like any other, after those with an id where scores tie. Repeated rows of documents are documents of their own; of equal rows either may
have the better rank. Rows of items with equal id and equal terms are one item; other items that share an id, or have none, are ranked each by itself
(`item_no` tells them apart). Very long texts are cut into terms piece by piece. An empty table on either side gives no rows. Only ids and texts are
looked at, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, tidy

#: Terms of the items that are searched for together, about; one longer item is a block of its own.
BLOCK_TERMS = 1 << 16
#: Nodes of an item among which pairs are mined together.
MINED = 256
#: Accumulators of a batch of documents, at most about.
CELLS = 1 << 21
#: Bytes of a text that are cut into terms at once.
PIECE = 1 << 20
#: Groups of tasks whose best documents are merged first.
MERGE = 256

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> Counter:
    """Occurrences of the terms of a text: runs of ASCII letters, digits and all other characters, A-Z lower-cased."""
    raw, found, at = (text or "").encode("utf-8", "surrogatepass").translate(_TERM), Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


class Graph:
    """Nodes of term sets: ``parts[k]`` are the two nodes that node ``leaves + k`` sums, ``ends[i]`` the nodes of item i."""

    def __init__(self, items: list[list[int]], leaves: int):
        self.leaves, self.parts = leaves, []
        # terms that stand in the same items are summed first
        holders: dict[int, list[int]] = {}
        for i, own in enumerate(items):
            for t in own:
                holders.setdefault(t, []).append(i)
        alike: dict[tuple[int, ...], int] = {}
        for t in sorted(holders):
            key = tuple(holders[t])
            alike[key] = self._node(alike[key], t) if key in alike else t
        shared: list[list[int]] = [[] for _ in items]
        self.ends: list[list[int]] = [[] for _ in items]
        for key, node in alike.items():
            for i in key:
                (shared if len(key) > 1 else self.ends)[i].append(node)
        self._mine(shared, {node: len(key) for key, node in alike.items()})
        self.levels = self._levels()

    def _node(self, a: int, b: int) -> int:
        self.parts.append((a, b))
        return self.leaves + len(self.parts) - 1

    def _mine(self, shared: list[list[int]], often: dict[int, int]) -> None:
        """Turn the pair that most items hold into a node, until no pair is held twice; long items are mined in pieces of common nodes."""
        pieces = []
        for i, own in enumerate(shared):
            own = sorted(own, key=lambda n: (-often[n], n))
            pieces += [(i, set(own[at:at + MINED])) for at in range(0, len(own), MINED)]
        where: dict[tuple[int, int], set[int]] = {}
        for p, (_, own) in enumerate(pieces):
            for a in own:
                for b in own:
                    if a < b:
                        where.setdefault((a, b), set()).add(p)
        heap = [(-len(held), pair) for pair, held in where.items() if len(held) > 1]
        heapify(heap)
        while heap:
            count, (a, b) = heappop(heap)
            held = where.get((a, b), set())
            if len(held) != -count:
                if len(held) > 1:
                    heappush(heap, (-len(held), (a, b)))
                continue
            node = self._node(a, b)
            for p in sorted(held):
                own = pieces[p][1]
                own -= {a, b}
                for x in own:
                    for y in (a, b):
                        where[min(x, y), max(x, y)].discard(p)
                    where.setdefault((x, node), set()).add(p)
                own.add(node)
            where.pop((a, b))
            for x in {x for p in held for x in pieces[p][1]} - {node}:
                if len(where[x, node]) > 1:
                    heappush(heap, (-len(where[x, node]), (x, node)))
        for i, own in pieces:
            self.ends[i] += sorted(own)

    def _levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The nodes that can be made together, with their parts."""
        depth = np.zeros(self.leaves + len(self.parts), np.int64)
        for k, (a, b) in enumerate(self.parts):
            depth[self.leaves + k] = 1 + max(depth[a], depth[b])
        parts = np.array(self.parts, np.int64).reshape(-1, 2)
        nodes = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
        return [(n, *parts[n - self.leaves].T) for n in nodes]

    def scores(self, leaves: np.ndarray) -> np.ndarray:
        """[item, document] of the accumulators [term, document]."""
        nodes = np.empty((self.leaves + len(self.parts), leaves.shape[1]), np.int64)
        nodes[:self.leaves] = leaves
        for made, a, b in self.levels:
            nodes[made] = nodes[a] + nodes[b]
        return np.stack([nodes[own].sum(0) for own in self.ends])


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["id"], "terms": [sorted(terms_of(t)) for t in pdf["text"]]})


def _counted(number: dict[bytes, int]):
    """Documents with a term: how many terms they have, and which of the numbered ones how often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, none, text in zip(pdf["id"], pdf["none"], pdf["text"]):
                if n := (found := terms_of(text)).total():
                    own = sorted((number[t], k) for t, k in found.items() if t in number)
                    rows.append((i, none, n, [t for t, _ in own], [k for _, k in own]))
            yield pd.DataFrame(rows, columns=["id", "none", "n", "terms", "often"])

    return run


class _Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)
        self.kept = np.zeros((0, 4), np.int64)  # item, score, whether the id is null, id

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.kept = np.concatenate([self.kept, np.stack([item, scores[item, doc], none[doc], ids[doc]], 1)])
        if len(self.kept) > 8 * self.top * len(self.least):
            self.cut()

    def cut(self) -> np.ndarray:
        k = self.kept[np.lexsort((self.kept[:, 3], self.kept[:, 2], -self.kept[:, 1], self.kept[:, 0]))]
        place = np.arange(len(k)) - np.searchsorted(k[:, 0], k[:, 0])
        self.kept = k[place < self.top]
        last = k[place == self.top - 1]
        self.least[last[:, 0]] = last[:, 1]
        return self.kept


def _ranked(graph: Graph, weights: np.ndarray, n_docs: int, all_terms: int, top: int):
    """The best documents of each item in the task."""
    rows = max(1, CELLS // max(1, graph.leaves + len(graph.parts) + len(graph.ends)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        best = _Best(len(graph.ends), top)
        for pdf in batches:
            for lo in range(0, len(pdf), rows):
                part = pdf.iloc[lo:lo + rows]
                held = part["terms"].map(len).to_numpy()
                doc = np.repeat(np.arange(len(part)), held)
                term, tf = (np.concatenate([np.asarray(x, np.int64) for x in part[c]]) for c in ("terms", "often"))
                m = np.array([50 + 50 * int(n) * n_docs // all_terms for n in part["n"]], np.int64)
                leaves = np.zeros((graph.leaves, len(part)), np.int64)
                leaves[term, doc] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                best.add(graph.scores(leaves), part["id"].to_numpy(np.int64), part["none"].to_numpy(np.int64))
        kept = best.cut()
        yield pd.DataFrame({"item": kept[:, 0], "score": kept[:, 1], "none": kept[:, 2] > 0, "id": kept[:, 3], "task": TaskContext.get().partitionId()})

    return run


def _blocks(items: DataFrame, scratch: Scratch) -> Iterator[list]:
    """The distinct items, block by block: rows of (id, terms)."""
    found = items.mapInPandas(tidy(_terms), "id string, terms array<binary>").where(F.size("terms") > 0).dropDuplicates(["id", "terms"])
    found = scratch.write(found, "items")
    total = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS)
    key = F.xxhash64("id", "terms")
    while blocks > 1 and found.groupBy(F.pmod(key, F.lit(blocks)).alias("b")).agg(F.sum(F.size("terms")).alias("n"), F.count("*").alias("k")).where(f"n > {2 * BLOCK_TERMS} AND k > 1").limit(1).count():
        blocks *= 2
    for b in range(blocks):
        if rows := found.where(F.pmod(key, F.lit(blocks)) == b).sort("id", "terms").collect():
            yield rows


def lexical_search(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", top: int = 50) -> DataFrame:
    """The ``top`` best documents of each item: item id, item_no, rank, document id, score."""
    bounded_batches(spark)
    scratch = Scratch(spark, "lexical-search")
    own = F.col(id_col).cast("long")
    docs = docs.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("none"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"))
    made = []
    for b, block in enumerate(_blocks(items, scratch)):
        made.append(_searched(scratch, docs, block, b, top))
    found = made[0] if made else spark.createDataFrame([], "item_id long, item_no long, rank int, doc_id long, score long")
    for more in made[1:]:
        found = found.unionByName(more)
    return found.select(F.col("item_id").alias(item_col), "item_no", "rank", F.col("doc_id").alias(id_col), "score")


def _searched(scratch: Scratch, docs: DataFrame, block: list, b: int, top: int) -> DataFrame:
    number = {t: k for k, t in enumerate(sorted({bytes(t) for row in block for t in row["terms"]}))}
    counted = scratch.write(docs.mapInPandas(tidy(_counted(number)), "id long, none boolean, n long, terms array<int>, often array<long>"), f"counted-{b}")
    n_docs, all_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(number), np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the terms of the block
        df[term] = n
    weights = np.array([weight(n_docs, int(k)) for k in df], np.int64)
    graph = Graph([[number[bytes(t)] for t in row["terms"]] for row in block], len(number))
    best = counted.where(F.size("terms") > 0).mapInPandas(tidy(_ranked(graph, weights, n_docs, all_terms, top)), "item int, score long, none boolean, id long, task int")

    def first(df: DataFrame, *key: Column | str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "none", "id"))
        return df.withColumn("rank", place).where(F.col("rank") <= top)

    best = first(best.withColumn("group", F.pmod("task", F.lit(MERGE))), "item", "group").drop("rank")
    names = best.sparkSession.createDataFrame([(k, None if row["id"] is None else int(row["id"]), (b << 32) + k) for k, row in enumerate(block)], "item int, item_id long, item_no long")
    ranked = first(best, "item").join(F.broadcast(names), "item")  # a row for each item of the block
    return ranked.select("item_id", "item_no", "rank", F.when(~F.col("none"), F.col("id")).alias("doc_id"), "score")


ORACLE = r"""
WITH split AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM split GROUP BY ALL),
sized AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY 1),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sized),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weighed AS (SELECT term, floor(1000 * ln((2 * any_value(t.docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, total t GROUP BY term),
part AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * t.docs) // t.words)))) AS s
    FROM counted JOIN weighed USING (term) JOIN sized USING (doc_id), total t),
scored AS (SELECT item_id, doc_id, sum(s)::BIGINT AS score FROM wanted JOIN part USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
