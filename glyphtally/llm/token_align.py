"""Alignment of two tokenizers over a corpus, each distinct text once.

Documents are shuffled by their full text, so that every distinct text is tokenised and aligned once, however many documents hold it. Counts
of token pairs weigh a text by that number. Measures go back to documents by a join on a 128-bit hash of the text.

A is a byte-level BPE, B a piece model with byte fallback; both read a space and the text. Their tokens stand for bytes. Where tokens
of both end at one byte, a group ends, and the two tokens are linked. A pair's count is the number of its links in the whole corpus; a
link is best if no other partner of its B token has a higher count.

Distinct pairs are bounded by the product of the vocabularies, far beyond what a task should hold. Up to BROADCAST pairs go to all tasks as
arrays; beyond that, each text's distinct pairs are joined with the counts and summed by text.

Tokens of neither tokenizer go on over a space after a character that is no white space: A cuts there before it merges, and no piece of B holds
a space behind another character (looked up in the vocabulary; with other pieces texts are read in one). Texts are therefore cut there into words,
and a task reads equal words once, as far as it keeps them; where most words are new to it, it reads texts in one. A text's tokens are those of its words, one after the other. Texts with a word whose tokens do not give back its bytes are read in one.

Nulls: documents whose text is null or empty, or whose tokens do not give back its bytes, have zeros and an empty digest; a null id stays null.
Repeated rows have rows of their own and weigh as often as they stand. Ties: all partners with the highest count are best. Very long texts
are read whole. An empty table gives no rows. Only the id and the text are looked at, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, compress, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, chunks, tidy
from .token_order import PATTERN

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Pairs that are broadcast, at most: 16 bytes each.
BROADCAST = 4_000_000
#: A run of so many characters without white space, or of white space, is merged by the encoder whose time does not grow with its square.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
#: From a space to the next that follows a character other than white space; white space at the text's end stays with what is before it.
WORD = re.compile(r" \s*\S*(?:[^\S ]\s*\S+)*(?:\s+\Z)?")
#: Characters of the words that a task keeps, about.
KEPT = 3 << 20


class Aligned(NamedTuple):
    """Tokens of A and B in a text or a word."""

    n_a: int
    n_b: int
    #: groups as ``a1,a2|b1;a3|b2,b3``
    groups: str
    #: a long per link, of A's id and B's
    links: bytes


def joined(parts: list[Aligned]) -> Aligned:
    """The parts, one after the other."""
    n_a, n_b, groups, links = zip(*parts)
    return Aligned(sum(n_a), sum(n_b), ";".join(groups), b"".join(links))


class Tokenizers:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.hub = Tokenizer.from_file(a_file)
        self.hub.encode_special_tokens = True
        self.piece = sentencepiece.SentencePieceProcessor(model_file=b_file)
        with open(a_file, encoding="utf-8") as f:
            made = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte-level alphabet shows as themselves
        byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
        special = {t["content"] for t in made["added_tokens"]}
        self.bytes_a = {i: bytes(byte[c] for c in t) for t, i in made["model"]["vocab"].items() if t not in special}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.piece.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.piece.id_to_piece(i)) for i in range(self.piece.get_piece_size()))]
        # this vocabulary's ids are in the order of its merges, which another encoder takes as ranks
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in self.bytes_a.items()}, special_tokens={}).encode_ordinary
        self.cuts = not any("▁" in self.piece.id_to_piece(i).lstrip("▁") for i in range(self.piece.get_piece_size()))
        most_a = 1 + max(self.bytes_a)
        self.length_a = np.fromiter((len(self.bytes_a.get(i, b"")) for i in range(most_a)), np.int64, most_a)
        self.length_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        self.shown = [f"{i}{mark}" for i in range(max(most_a, len(self.bytes_b))) for mark in ",|;\n"]
        self.known: dict[str, Aligned | None] = {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        """A space and the text, cut where tokens of both end."""
        return WORD.findall(" " + text) if self.cuts else [" " + text]

    def read(self, words: list[str]) -> list[Aligned | None]:
        """What each word gives that begins with a space: None if its tokens do not give back its bytes."""
        all_a = [self.hub.encode(w, add_special_tokens=False).ids if LONG_RUN.search(w) else self.fast(w) for w in words]
        all_b = self.piece.encode([w[1:] for w in words], num_threads=1)
        own_a, own_b, kept = self.bytes_a.get, self.bytes_b.__getitem__, []
        for w, a, b in zip(words, all_a, all_b):
            kept.append(b"".join(map(own_a, a, repeat(b""))) == (raw := w.encode()) and b"".join(map(own_b, b)) == raw)
        made = self._aligned(list(compress(all_a, kept)), list(compress(all_b, kept)))
        return [next(made) if k else None for k in kept]

    def _aligned(self, all_a: list[list[int]], all_b: list[list[int]]) -> Iterator[Aligned]:
        """Groups and links of words whose tokens of A and B have the same bytes."""
        if not all_a:
            return
        (a, sizes_a), (b, sizes_b) = ((np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64)) for ids in (all_a, all_b))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        # every token has a byte at least, so no two tokens of a side end together: a common end is one link
        in_a, in_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_b[-1] + 1, bool)
        in_a[ends_a] = in_b[ends_b] = True
        last_a, last_b = in_b[ends_a], in_a[ends_b]
        links = (a[last_a] << 32 | b[last_b]).tobytes()
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.append(0, upto_b)[np.cumsum(last_a) - last_a]] = 4 * a + last_a
        final = np.cumsum(sizes_b) - 1
        marks = 2 * last_b
        marks[final] = 3
        codes[np.arange(len(b)) + upto_a[np.cumsum(last_b) - last_b]] = 4 * b + marks
        groups = "".join(map(self.shown.__getitem__, codes.tolist())).split("\n")
        before = np.append(0, 8 * np.cumsum(last_b)[final]).tolist()
        for n_a, n_b, own, lo, hi in zip(sizes_a.tolist(), sizes_b.tolist(), groups, before, before[1:]):
            yield Aligned(n_a, n_b, own, links[lo:hi])

    def align(self, texts: list[str | None]) -> Iterator[Aligned | None]:
        """What each text gives: None if it has no tokens."""
        for lo, hi in chunks(texts, 1 << 20):
            cut = [self.words(t) if t else [] for t in texts[lo:hi]]
            if self.held > KEPT:
                self.known.clear()
                self.held = 0
            new = [w for w in set().union(*cut) if w not in self.known]
            if 2 * len(new) > sum(map(len, cut)):  # words that hardly come again cost more than they save
                whole = iter(self.read([" " + t for t in texts[lo:hi] if t]))
                yield from (next(whole) if t else None for t in texts[lo:hi])
                continue
            self.known.update(zip(new, self.read(new)))
            self.held += sum(map(len, new))
            for text, words in zip(texts[lo:hi], cut):
                parts = [self.known[w] for w in words]
                yield self.read([" " + text])[0] if None in parts else joined(parts) if parts else None


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    """Loaded once a worker."""
    if (a_file, b_file) not in _LOADED:
        _LOADED[a_file, b_file] = Tokenizers(a_file, b_file)
    return _LOADED[a_file, b_file]


MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _aligned(a_file: str, b_file: str):
    """A text's measures, its distinct pairs and how often each is linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            both, rows = tokenizers(a_file, b_file), []
            for found in both.align(pdf["text"].tolist()):
                if found is None:
                    rows.append((0, 0, 0, 0, "", b"", b""))
                    continue
                links = np.frombuffer(found.links, np.int64)
                pairs, times = np.unique(links, return_counts=True)
                packed = (squeeze.compress(pairs.tobytes()), squeeze.compress(times.astype(np.int64).tobytes()))
                digest = hashlib.sha256(found.groups.encode()).hexdigest()
                rows.append((found.n_a, found.n_b, len(links), len(links), digest, *packed))  # each group ends in a link
            out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
            yield pd.concat([pdf[["h1", "h2", "copies"]].reset_index(drop=True), out], axis=1)

    return run


def _loosened(packed: bytes, loosen=None) -> np.ndarray:
    return np.frombuffer((loosen or zstandard.ZstdDecompressor()).decompress(packed), np.int64) if packed else np.zeros(0, np.int64)


def _pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links per pair, summed over batches."""
    held, size = [], 0

    def flush() -> pd.DataFrame:
        pair, of = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, of, np.concatenate([t for _, t in held]))
        held.clear()
        return pd.DataFrame({"pair": pair, "n": n})

    for pdf in batches:
        for copies, pairs, times in zip(pdf["copies"], pdf["pairs"], pdf["times"]):
            if pairs:
                held.append((_loosened(pairs), _loosened(times) * copies))
                size += len(held[-1][0])
            if size > 1 << 22:
                yield flush()
                size = 0
    if held:
        yield flush()


def _scored(pairs_of_all, counts_of_all):
    """count_sum and n_best of a text, from counts that are negative where they are their B id's highest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, count = pairs_of_all.value, counts_of_all.value
        for pdf in batches:
            best, total = [], []
            for pairs, times in zip(pdf["pairs"], pdf["times"]):
                times, own = _loosened(times), count[np.searchsorted(known, _loosened(pairs))]
                best.append(int(times[own < 0].sum())), total.append(int((times * np.abs(own)).sum()))
            yield pdf.drop(columns=["copies", "pairs", "times"]).assign(n_best=best, count_sum=total)

    return run


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per text and distinct pair."""
    for pdf in batches:
        for h1, h2, pairs, times in zip(pdf["h1"], pdf["h2"], pdf["pairs"], pdf["times"]):
            yield pd.DataFrame({"h1": h1, "h2": h2, "pair": _loosened(pairs), "times": _loosened(times)})


class Alignment:
    """The written tables of one alignment: `texts`, a row per distinct text, and `counts` (pair, b, n, best), a row per pair."""

    def __init__(self, spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE):
        bounded_batches(spark)
        self.spark, scratch = spark, Scratch(spark, "token-align")
        text = F.col(text_col)
        self.docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.isNull().alias("none"))
        once = df.where(text.isNotNull()).groupBy(text.alias("text")).agg(F.count("*").alias("copies"))
        once = once.select("text", "copies", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
        self.texts = scratch.write(once.mapInPandas(tidy(_aligned(a_file, b_file)), f"h1 long, h2 long, copies long, {MEASURES}, pairs binary, times binary"), "texts")
        counts = self.texts.select("copies", "pairs", "times").mapInPandas(tidy(_pair_counts), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        counts = scratch.write(counts.withColumn("b", F.expr("pair & 4294967295")), "pairs")
        highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
        self.counts = scratch.write(counts.join(highest, "b").select("pair", "b", "n", (F.col("n") == F.col("highest")).alias("best")), "counts")

    def by_text(self, broadcast: int) -> DataFrame:
        """The measures of every distinct text."""
        columns = f"h1 long, h2 long, {MEASURES}, n_best long, count_sum long"
        if self.counts.count() <= broadcast:
            held = self.counts.select("pair", F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("n")).toPandas().sort_values("pair")
            sent = [self.spark.sparkContext.broadcast(held[c].to_numpy(np.int64)) for c in ("pair", "n")]
            return self.texts.mapInPandas(tidy(_scored(*sent)), columns)
        rows = self.texts.mapInPandas(tidy(_spread), "h1 long, h2 long, pair long, times long").join(self.counts, "pair")
        sums = rows.groupBy("h1", "h2").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.expr("sum(times * n)").alias("count_sum"))
        return self.texts.drop("copies", "pairs", "times").join(sums, ["h1", "h2"], "left")


def align_tokens(
    spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, broadcast: int = BROADCAST) -> DataFrame:
    """One row per row of ``df``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    made = Alignment(spark, df, id_col, text_col, a_file, b_file)
    texts = made.by_text(broadcast).withColumn("none", F.lit(False))
    out = made.docs.join(texts, ["h1", "h2", "none"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.select(F.col("id").alias(id_col), *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def token_pairs(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """One row per pair of tokens linked anywhere: a, b, n, and whether no other partner of b has more."""
    counts = Alignment(spark, df, id_col, text_col, a_file, b_file).counts
    return counts.select(F.expr("shiftright(pair, 32)").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n", "best")
