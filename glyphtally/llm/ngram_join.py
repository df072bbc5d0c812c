"""N-gram Jaccard join by count vectors in R-trees.

A document's tokens are its distinct five-word shingles, hashed to 64 bits. Each token also falls
into one of GROUPS groups; the counts per group are the document's point. Two documents cannot
share more tokens than the sum of their points' coordinate minima, so an R-tree over the points,
whose nodes hold coordinate maxima and size ranges, finds all points that may share enough.

Long texts have finer groups, which are summed for the tree and compared as they are where both
sides have them.

Documents meet in the buckets of their prefix tokens: of sets with similarity t or more, the
first n - ceil(t n) + 1 tokens in any common order have one in common, so no link is lost. Frequent
tokens come last in that order. Copies (equal sets) are one class throughout.

Components come first: each class is compared with the first class of its buckets, which joins large groups of near copies by
a number of comparisons in proportion to their tokens; then buckets whose other classes still lie in several components are
searched for pairs across them. Those with the same first class are laid together, each class once, and go through one R-tree, so that two
classes do not meet again for every token they share; where that would compare more than the single buckets do, these stay single. Every pair that the bounds let through is verified on the whole sets.

All links lie inside components, so links are counted there (``count_links``): a component's classes are dealt out in
blocks, an R-tree over each block finds the pairs of blocks that may be similar, and the whole sets decide. A class's count
weighs linked classes by their rows, so copies are not expanded into pairs. `ngram_jaccard_links` gives the pairs of classes themselves; comparisons grow with the square of a
component's classes, as its links do.

Nulls, empty texts: empty set, no links, a component of their own. Repeated rows: one result row
each, and links with each other. Repeated ids with different texts are separate documents: rows are known by a hash of id and text throughout, and ids only name classes and components. Rows without id have their n_shingles, but no class, component or links, and leave other rows as they are. Ties: of equal
sets, and in a component, the smallest id names it. Very long texts are read whole. An empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, connected, maybe_in, shingle_sets, tidy, without_ids

GROUPS = 256
WIDTH = 5
#: Tokens counted as frequent, at most; a bound of the broadcast that orders tokens.
FREQUENT = 1 << 16
#: Points in one R-tree; larger buckets are dealt out in blocks of about so many.
BLOCK = 1024
LEAF, FAN = 16, 8
#: Pairs with one document that are verified together.
PARTNERS = 256
#: Sets and tokens in one block of a component, about.
BLOCK_SETS, BLOCK_TOKENS = 256, 1 << 20
#: Tokens of the texts in which `_frequent` looks for recurring ones at once.
COUNTED = 1 << 20
#: Bits of a token that name its bucket. Tokens that agree in these share a bucket, which only brings pairs that the bounds turn down; the others are zeros, which cost a shuffle nothing.
KEY = np.uint64(0xFFFFFFFFFF << 24)


def needed(a, b, pct: int):
    """Least intersection of sets with sizes a and b at a Jaccard similarity of pct / 100."""
    return -((-pct * (a + b)) // (100 + pct))


def summed_minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(1, dtype=np.int64)


class CountTree:
    """R-tree over count vectors, packed by sorting; a node keeps coordinate maxima and a size range."""

    def __init__(self, points: np.ndarray, size: np.ndarray | None = None, excess: np.ndarray | None = None):
        """``points`` may hold counts cut at 255 as bytes; ``size`` and ``excess`` then say what they were."""
        self.points, size = points, points.sum(1) if size is None else size
        self.excess = np.zeros(len(points), np.int64) if excess is None else excess
        spread = int(np.argmax(points.var(0))) if len(points) > LEAF else 0
        slabs = max(1, int(np.sqrt(len(points) / LEAF)))
        by_size = np.argsort(size, kind="stable")
        slab = np.empty(len(points), np.int64)
        slab[by_size] = np.arange(len(points)) * slabs // max(1, len(points))
        self.order = np.lexsort((points[:, spread], slab))
        self.levels = []
        high, low, top, more = points[self.order], size[self.order], size[self.order], self.excess[self.order]
        width = LEAF
        while len(high) > LEAF:
            cuts = np.arange(0, len(high), width)
            high, more = np.maximum.reduceat(high, cuts), np.maximum.reduceat(more, cuts)
            low, top = np.minimum.reduceat(low, cuts), np.maximum.reduceat(top, cuts)
            self.levels.append((width, high, low, top, more))
            width = FAN
        self.size = size

    def search(self, queries: np.ndarray, pct: int, size: np.ndarray | None = None, excess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, point) whose summed minima reach the needed intersection."""
        if not len(queries) or not len(self.points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        asked = queries.sum(1) if size is None else size
        extra = np.zeros(len(queries), np.int64) if excess is None else excess
        below = [len(self.points), *(len(level[1]) for level in self.levels)]
        q, node = np.repeat(np.arange(len(queries)), below[-1]), np.tile(np.arange(below[-1]), len(queries))
        for k in range(len(self.levels) - 1, -1, -1):
            width, high, low, top, more = self.levels[k]
            keep = self._pass(queries, asked, extra, q, high, node, low, top, more, pct)
            child = (node[keep][:, None] * width + np.arange(width)).ravel()
            q = np.repeat(q[keep], width)[child < below[k]]
            node = child[child < below[k]]
        point = self.order[node]
        keep = self._pass(queries, asked, extra, q, self.points, point, self.size, self.size, self.excess, pct)
        return q[keep], point[keep]

    @staticmethod
    def _pass(queries, asked, extra, q, high, node, low, top, more, pct) -> np.ndarray:
        n, near = asked[q], np.zeros(len(q), bool)
        sized = np.flatnonzero((100 * top[node] >= pct * n) & (pct * low[node] <= 100 * n))
        for at in np.array_split(sized, max(1, len(sized) * queries.shape[1] // (1 << 22))):
            shared = summed_minima(queries[q[at]], high[node[at]]) + np.minimum(extra[q[at]], more[node[at]])
            least = np.maximum(low[node[at]], -((-pct * n[at]) // 100))
            near[at] = shared >= needed(n[at], least, pct)
        return near


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _frequent(width: int):
    """Tokens that recur within a task's batches, with their counts there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            token, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"token": _signed(token[n > 2]), "n": n[n > 2]})

        for pdf in batches:
            for s in shingle_sets(pdf["text"].tolist(), width):
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return run


def _profiles(width: int, pct: int, frequent: np.ndarray):
    seldom = np.ones(1 << 22, bool)
    seldom[frequent >> np.uint64(42)] = False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s in shingle_sets(pdf["text"].tolist(), width):
                n = len(s)
                groups = groups_for(n)
                counts = np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)
                cut = np.minimum(counts, 255).astype(np.uint8)
                common = np.zeros(n, bool)
                if len(frequent) and len(at := np.flatnonzero(~seldom[s >> np.uint64(42)])):
                    k = np.minimum(np.searchsorted(frequent, s[at]), len(frequent) - 1)
                    common[at] = frequent[k] == s[at]
                first = np.concatenate((s[~common], s[common]))[: n - -(-pct * n // 100) + 1 if n else 0]
                m = s * np.uint64(0xD6E8FEB86659FD93)
                rows.append((n, _signed(s.sum(keepdims=True))[0], _signed(np.bitwise_xor.reduce(m ^ (m >> np.uint64(32)), keepdims=True))[0] if n else 0, zlib.compress(cut.tobytes(), 1), int(counts.sum() - cut.sum()), _signed(first & KEY)))
            out = pd.DataFrame(rows, columns=["n", "fa", "fb", "counts", "excess", "prefix"])
            out.insert(0, "id", pdf["id"].to_numpy())
            out.insert(1, "none", pdf["none"].to_numpy())
            out.insert(2, "name", pdf["name"].to_numpy())
            yield out

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "tokens": [s.tobytes() for s in shingle_sets(pdf["text"].tolist(), width)]})

    return run


def groups_for(n: int) -> int:
    """Groups for a set of n tokens: a power of two, so that a group holds about four tokens of a large set."""
    return max(GROUPS, 1 << max(0, (n // 4).bit_length()))


def _points(counts: list) -> np.ndarray:
    """Count vectors with finer groups summed to GROUPS."""
    out = np.empty((len(counts), GROUPS), np.uint32)
    for i, c in enumerate(counts):
        out[i] = np.frombuffer(c, np.uint8).reshape(GROUPS, -1).sum(1, dtype=np.uint32) if len(c) > GROUPS else np.frombuffer(c, np.uint8)
    return out


def fine_minima(a: bytes, b: bytes) -> int:
    """Sum of minima of two count vectors in the groups of the coarser one."""
    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    g = min(len(a), len(b))
    return int(np.minimum(a.reshape(g, -1).sum(1, dtype=np.int64), b.reshape(g, -1).sum(1, dtype=np.int64)).sum())


def _bounded(pct: int):
    """Pairs whose count vectors allow the needed intersection."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                shared = np.array([fine_minima(zlib.decompress(a), zlib.decompress(b)) for a, b in zip(pdf["ca"], pdf["cb"])]) + np.minimum(pdf["xa"], pdf["xb"])
                yield pdf.loc[shared >= needed(pdf["na"], pdf["nb"], pct), ["a", "b"]]

    return run


def _similar(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    both = np.sort(np.concatenate((x, y)), kind="stable")
    i = int((both[1:] == both[:-1]).sum())
    return 100 * i >= pct * (len(x) + len(y) - i)


def _verified(width: int, pct: int):
    """Pairs that link, of partitions sorted by (a, part, kind) in which a's text comes before those of its partners b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for pdf in batches:
            links = []
            for a, b, first, tokens in zip(pdf["a"], pdf["b"], pdf["kind"] == 0, shingle_sets(pdf["text"].tolist(), width)):
                if first:
                    own = tokens
                elif _similar(own, tokens, pct):
                    links.append((a, b))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return run


def _similar_pairs(left: list, right: list, pct: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of similar sets of two blocks: an R-tree over the points of one finds those that may be, the whole sets decide."""
    points = [np.array([np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=GROUPS) for s in side]) for side in (left, right)]
    q, p = CountTree(points[1]).search(points[0], pct)
    if same:
        q, p = q[q < p], p[q < p]
    if not len(q):
        return q, p
    # sizes of all intersections: products of 0/1 matrices over the tokens that more than one set holds
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    sides = left if same else left + right
    _, column, held = np.unique(np.concatenate(sides), return_inverse=True, return_counts=True)
    several = held > 1
    place = np.cumsum(several) - 1
    keep = several[column]
    column, row = place[column[keep]], np.repeat(np.arange(len(sides)), [len(s) for s in sides])[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    shared, width = np.zeros((len(left), len(right)), np.float32), max(1, (1 << 22) // len(sides))
    for lo in range(0, int(several.sum()), width):
        a, b = np.searchsorted(column, (lo, lo + width))
        matrix = np.zeros((len(sides), width), np.float32)
        matrix[row[a:b], column[a:b] - lo] = 1
        shared += matrix[:len(left)] @ (matrix if same else matrix[len(left):]).T
    both = shared[q, p].astype(np.int64)
    link = 100 * both >= pct * (sizes[0][q] + sizes[1][p] - both)
    return q[link], p[link]


def _within(pct: int, counted: bool):
    """The links inside components, of partitions sorted by pair of blocks: how many each class has, or the pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def found() -> pd.DataFrame:
            left, right = ([r for r in held if r[0] == k] for k in key[1:])
            if not left or not right:  # a block that got no class
                return pd.DataFrame({c: np.zeros(0, np.int64) for c in (("id", "far") if counted else ("a", "b"))})
            q, p = _similar_pairs([r[3] for r in left], [r[3] for r in right], pct, key[1] == key[2])
            a, b = (np.array([r[1] for r in side], np.int64) for side in (left, right))
            if not counted:
                return pd.DataFrame({"a": np.minimum(a[q], b[p]), "b": np.maximum(a[q], b[p])})
            m, n = (np.array([r[2] for r in side], np.float64) for side in (left, right))
            out = pd.DataFrame({"id": np.concatenate([a, b]), "far": np.concatenate([np.bincount(q, n[p], len(a)), np.bincount(p, m[q], len(b))]).astype(np.int64)})
            return out[out["far"] > 0]

        for pdf in batches:
            for row in zip(pdf["component"], pdf["bi"], pdf["bj"], pdf["block"], pdf["id"], pdf["members"], pdf["tokens"]):
                if row[:3] != key:
                    if held:
                        yield found()
                    key, held = row[:3], []
                held.append((*row[3:6], np.frombuffer(row[6], np.uint64)))
        if held:
            yield found()

    return run


def _buckets(pct: int):
    """Pairs across components in the buckets of a partition sorted by (lead, token, bi, bj), each bucket through its own R-tree."""

    def pairs(lo: int, hi: int, points, counts, sizes, excess, ids, comps, block, bi, bj) -> np.ndarray:
        left = right = np.arange(lo, hi)
        if bi[lo] != bj[lo]:
            left, right = left[block[lo:hi] == bi[lo]], right[block[lo:hi] == bj[lo]]
        q, p = CountTree(points[right], sizes[right], excess[right]).search(points[left], pct, sizes[left], excess[left])
        q, p = left[q], right[p]
        keep = (comps[q] != comps[p]) & ((ids[q] < ids[p]) | (bi[lo] != bj[lo]))
        fine = np.flatnonzero(keep & (np.minimum(sizes[q], sizes[p]) >= 4 * GROUPS))  # long texts have finer groups
        keep[fine] = [fine_minima(counts[i], counts[j]) + min(excess[i], excess[j]) >= needed(sizes[i], sizes[j], pct) for i, j in zip(q[fine], p[fine])]
        a, b = ids[q[keep]], ids[p[keep]]
        return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            yield from searched(pdf, False)
            rest = kept[0]
        if rest is not None and len(rest):
            yield from searched(rest, True)

    kept: list = [None]

    def searched(pdf: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
        key = pdf[["lead", "token", "bi", "bj"]].to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(pdf)] if last else [])).astype(int)
        counts = [zlib.decompress(c) for c in pdf["counts"]]
        columns = [_points(counts), counts, *(pdf[c].to_numpy() for c in ("n", "excess", "id", "component", "block", "bi", "bj"))]
        out = [pairs(lo, hi, *columns) for lo, hi in zip(cuts[:-1], cuts[1:])]
        kept[0] = pdf.iloc[cuts[-1]:]
        if out:
            yield pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])

    return run


def ngram_jaccard_links(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, pct: int = 75) -> DataFrame:
    """All links between different sets, as pairs (a, b) of class ids with a < b."""
    join = _Join(spark, df, id_col, text_col, width, pct)
    links, names = join.within(join.components(), False), join.sizes.select("class_id", "class_name")
    named = links.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
    return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def ngram_jaccard_join(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, pct: int = 75, count_links: bool = False, row_keys: bool = False) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, class_id (smallest id with an equal set), component_id.

    With ``count_links`` also n_links, the number of other rows whose set is similar or equal; with ``row_keys`` row_key, `row_key` of the row.
    """
    join = _Join(spark, df, id_col, text_col, width, pct)
    comps = join.components()
    named = comps.join(join.sizes.select(F.col("class_id").alias("node"), "class_name"), "node")
    named = named.groupBy("component").agg(F.min("class_name").alias("component_name"))
    comp_names = comps.join(named, "component").select(F.col("node").alias("class_id"), "component_name")
    out = join.classes.join(comp_names, "class_id", "left")
    columns = [F.col("name").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("class_name", "name").alias("class_id"), F.coalesce("component_name", "class_name", "name").alias("component_id")]
    if count_links:
        far = join.within(comps, True).groupBy("id").agg(F.sum("far").alias("far")).withColumnRenamed("id", "class_id")
        near = join.sizes.where("members > 1").join(far, "class_id", "full").select("class_id", (F.coalesce(F.col("members") - 1, F.lit(0)) + F.coalesce("far", F.lit(0))).alias("near"))
        out = out.join(near, "class_id", "left")
        columns.append(F.coalesce("near", F.lit(0)).cast("long").alias("n_links"))
    return out.select(*columns, *[F.col("id").alias("row_key")] * row_keys)


def row_key(id_col: str, text_col: str) -> Column:
    """What a row is known by: a hash of its id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


class _Join:
    """The steps of one join over written tables: `classes` (id, name, n, class_id, class_name) of the rows, `sizes` (class_id, class_name, members); ids here are row keys, names ids of the input."""

    def __init__(self, spark: SparkSession, df: DataFrame, id_col: str, text_col: str, width: int, pct: int):
        bounded_batches(spark)
        self.spark, self.width, self.pct, self.scratch = spark, width, pct, Scratch(spark, "ngram-join")
        # a null id would turn the ids of its whole batch into floats, so it goes along as a mark
        key = F.col(id_col).cast("long")
        docs = df.select(row_key(id_col, text_col).alias("id"), key.isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("name"), F.col(text_col).alias("text"))
        self.named = docs.where("NOT none").select("id", "text")

        counted = docs.select("text").mapInPandas(tidy(_frequent(width)), "token long, n long")
        often = counted.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT)
        frequent = np.sort(often.select("token").toPandas()["token"].to_numpy().astype(np.int64).view(np.uint64))
        self.profiles = self.scratch.write(docs.mapInPandas(tidy(_profiles(width, pct, frequent)), "id long, none boolean, name long, n long, fa long, fb long, counts binary, excess long, prefix array<long>"), "profiles")
        named = self.profiles.where("n > 0 AND NOT none")
        classes = named.groupBy("fa", "fb", "n").agg(F.min(F.struct("name", "id")).alias("first"))
        classes = classes.select("n", "fa", "fb", F.col("first.id").alias("class_id"), F.col("first.name").alias("class_name"))
        given = lambda c: F.when(~F.col("none"), F.col(c)).alias(c)
        rows = self.profiles.select(given("id"), given("name"), "none", "n", "fa", "fb")
        classes = rows.join(classes, ["fa", "fb", "n"], "left").select("id", "name", "n", given("class_id"), given("class_name"))
        self.classes = self.scratch.write(classes, "classes")
        self.sizes = self.scratch.write(self.classes.where("class_id IS NOT NULL").groupBy("class_id").agg(F.count("*").alias("members"), F.first("n").alias("n"), F.first("class_name").alias("class_name")), "sizes")
        self.held = named.select("id", "n", "counts", "excess")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(id, text) of the documents with these ids, once each, lying by id."""
        return maybe_in(self.named, "id", ids, "id").join(ids, "id").dropDuplicates(["id"])

    def sets(self, ids: DataFrame) -> DataFrame:
        """(id, tokens) of the documents with these ids, from their texts."""
        return self.texts(ids).mapInPandas(tidy(_sets(self.width)), "id long, tokens binary")

    def bounded(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs of classes whose sizes and count vectors allow a link; the sizes decide first, as vectors are long."""
        pairs = pairs.distinct()
        for end in ("a", "b"):
            pairs = pairs.join(self.sizes.select(F.col("class_id").alias(end), F.col("n").alias(f"n{end}")), end)
        pairs = pairs.where(f"100 * na >= {self.pct} * nb AND 100 * nb >= {self.pct} * na")
        for end in ("a", "b"):
            pairs = pairs.join(self.held.select(F.col("id").alias(end), F.col("counts").alias(f"c{end}"), F.col("excess").alias(f"x{end}")).dropDuplicates([end]), end)
        wide = pairs.select("a", "na", "ca", "xa", "b", "nb", "cb", "xb")
        return self.scratch.write(wide.mapInPandas(tidy(_bounded(self.pct)), "a long, b long"), f"{name}-bounded")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link. The text of b comes with each pair, that of a once for PARTNERS pairs, so no task holds more than one set. Texts are shuffled and not sets, whose hashes are longer and do not compress."""
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).cast("int").alias("parts"))
        placed = pairs.join(parts, "a").select("a", "b", F.pmod(F.hash("b"), "parts").alias("part"))
        placed = self.scratch.write(placed, f"{name}-placed")
        roles = placed.select("a", "part", F.lit(1).alias("kind"), "b", F.col("b").alias("id")).unionByName(
            placed.select("a", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("b"), F.col("a").alias("id")).distinct())
        both = roles.join(self.texts(roles.select("id").distinct()), "id").drop("id")
        links = both.repartition("a", "part").sortWithinPartitions("a", "part", "kind").mapInPandas(tidy(_verified(self.width, self.pct)), "a long, b long")
        return self.scratch.write(links, f"{name}-links")

    def components(self) -> DataFrame:
        """(node, component) of the linked classes: exact, though links inside a component found so far are not looked for."""
        scratch = self.scratch
        # (token, class, first class of the token's bucket), for tokens of more than one class
        copies = self.classes.where("class_id <> id").select("id")
        rows = without_ids(self.profiles.where("n > 0 AND NOT none").select("id", "name", "prefix"), "id", copies, "id")
        rows = rows.select(F.explode("prefix").alias("token"), "id", "name").repartition("token")
        bucket, one = Window.partitionBy("token"), F.struct("name", "id")  # a window, as a groupBy and a join shuffle all tokens twice
        rows = rows.select("token", "id", F.min(one).over(bucket).alias("lead"), F.max(one).over(bucket).alias("last")).where("lead < last")
        rows = scratch.write(rows.select("token", "id", F.col("lead.id").alias("lead"), F.col("lead.name").alias("lead_name")), "rows")

        # each class with the first class of its buckets: that of most of them, then those of other components
        leads = scratch.write(rows.where("id <> lead").groupBy("id", "lead").agg(F.count("*").alias("often"), F.first("lead_name").alias("lead_name")), "leads")
        best = leads.groupBy("id").agg(F.max_by("lead", F.struct("often", -F.col("lead_name"), "lead")).alias("a")).select("a", F.col("id").alias("b"))
        comps = connected(scratch, self.verified(self.bounded(best, "best"), "best"), "a", "b", "best-comp")
        comps = scratch.write(comps, "best-comps")
        rest = leads.select(F.col("lead").alias("a"), F.col("id").alias("b"))
        for end in ("a", "b"):
            rest = rest.join(comps.toDF(end, f"c{end}"), end, "left")
        rest = rest.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
        links = self.verified(self.bounded(rest, "leads"), "leads")
        comps = connected(scratch, comps.toDF("a", "b").union(links), "a", "b", "leads-comp")

        # all pairs across components that trees find; each class has met the first one of its buckets, which needs no place in them
        comps = scratch.write(comps, "leads-comps")
        placed = rows.where("id <> lead").select("token", "lead", "id").join(comps.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        placed = placed.select("*", F.min("component").over(bucket).alias("c0"), F.max("component").over(bucket).alias("c1"), F.count("*").over(bucket).alias("held"))
        placed = scratch.write(placed.where("c0 < c1").select("token", "lead", "id", "component", "held"), "mixed")
        joint = placed.groupBy("lead").agg(F.countDistinct("id").alias("ids"), F.sum("held").alias("apart")).select("lead", F.expr(f"ids <= {BLOCK} OR ids * ids <= apart").alias("joint"))
        placed = placed.join(joint, "lead").select("lead", F.when(F.col("joint"), F.lit(0)).otherwise(F.col("token")).alias("token"), "id", "component").distinct()
        blocks = F.ceil(F.count("*").over(Window.partitionBy("lead", "token")) / F.lit(BLOCK)).cast("int")
        placed = scratch.write(placed.withColumn("blocks", blocks), "placed")
        placed = placed.withColumn("block", F.pmod(F.hash("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        dealt = placed.join(self.held.dropDuplicates(["id"]), "id").select("lead", "token", "id", "component", "block", "bi", "bj", "n", "counts", "excess")
        found = dealt.repartition("lead", "token", "bi", "bj").sortWithinPartitions("lead", "token", "bi", "bj").mapInPandas(tidy(_buckets(self.pct)), "a long, b long")
        links = self.verified(scratch.write(found.distinct(), "found"), "trees")
        return scratch.write(connected(scratch, comps.toDF("a", "b").union(links), "a", "b", "all-comp"), "comps")

    def within(self, comps: DataFrame, counted: bool) -> DataFrame:
        """The links of each component: (id, far), the rows that a class is linked with per pair of blocks, or pairs (a, b).

        A component's classes are dealt out in blocks, and every pair of blocks is searched through an R-tree and verified by itself.
        """
        own = comps.join(self.sizes.withColumnRenamed("class_id", "node"), "node").withColumnRenamed("node", "id")
        total = own.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS))).cast("int").alias("blocks"))
        own = self.scratch.write(own.join(total, "component").select("id", "component", "members", "blocks", F.pmod(F.hash("id"), "blocks").alias("block")), "within")
        sets = own.join(self.sets(own.select("id")), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sets = sets.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        # the pairs of blocks of a component go to partitions in turn
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        turn = F.pmod(F.hash("component").cast("long") + F.col("bi") + F.expr("bj * (bj + 1L) div 2"), F.lit(parts)).cast("int")
        dealt = sets.select("component", "bi", "bj", "block", "id", "members", "tokens").repartitionById(parts, turn).sortWithinPartitions("component", "bi", "bj")
        return dealt.mapInPandas(tidy(_within(self.pct, counted)), "id long, far long" if counted else "a long, b long")
