"""Removal of repeated passages, by recompression.

Recompression rewrites all word sequences at once, in rounds: runs of one symbol become a symbol, then pairs of a left and a right symbol do, where a
bit of its name says which side a symbol is on. Names are hashes of what they stand for, so all tasks name alike without a dictionary, and equal
passages get equal symbols inside. Symbols grow to at most CAP words. Each symbol knows its reach: the words that decided that it stands there and
nothing else. A window that contains the reach contains the symbol wherever the window occurs, so the set of such symbols is a property of the
window's words alone, and so is its choice: the largest symbol, then that with the least hash, then the leftmost.

Only chosen symbols are shuffled, a fraction of a row for each word. A symbol of one document decides that its windows do not repeat. A symbol whose
surroundings, as wide as any window around it, are alike wherever it was chosen decides that they all repeat. Of surroundings that differ, documents with the same ones
as a document before them are decided too. What is left open, and windows without a symbol (in long runs of a word), are compared by 128-bit hashes of their 50 words,
which verifies them. So the result is exact, whatever the symbols are.

A window repeats if its words also start in a document with a smaller id; every word of such a window is removed, on the evidence of the input, not of
what is left.

Nulls and empty texts: no words, nothing removed. A row without id is never a document before others and loses nothing. Rows with one id
never make each other lose words, and of repeated rows each has its row. Texts with fewer words than a window stay. Ties cannot arise. Very long texts are
parsed in overlapping segments. An empty table gives no rows. Only the id and the text are looked at, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CASED, FILTER_CELLS, Scratch, bounded_batches, chunks, mix64, tidy, word_hashes

WINDOW = 50
#: Words in a symbol, at most; rounds of pairs; the rounds that begin with runs.
CAP, ROUNDS, RUNS = 12, 6, (0, 2)
#: Characters, and words, that are hashed or parsed at once, about.
PIECE, SEGMENT = 1 << 18, 1 << 17
FAR = np.int64(1) << 40
SPACE = re.compile(r"[\x20\x09-\x0D]")
DECIDED, OPEN = 1, 2

_MASK = (1 << 64) - 1
_P = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _u(x: int) -> np.ndarray:
    return np.array([x & _MASK], np.uint64)


def pieces(text: str | None) -> Iterator[str]:
    """The text in pieces that end before white space."""
    at, text = 0, text or ""
    while at < len(text):
        found = SPACE.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def hashed(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts, letter case kept, and each text's bounds."""
    cut = [(k, p) for k, t in enumerate(texts) for p in pieces(t)]
    out, held = [], np.zeros(len(texts), np.int64)
    for lo, hi in chunks([p for _, p in cut], PIECE):
        h, bounds = word_hashes([p for _, p in cut[lo:hi]], CASED)
        out.append(h)
        np.add.at(held, [k for k, _ in cut[lo:hi]], np.diff(bounds))
    return np.concatenate([*out, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum(held)))


class Parse:
    """The symbols of the last round over segments of word hashes: name, segment, first word, number of words, and reach [low, high)."""

    def __init__(self, words: np.ndarray, segment: np.ndarray):
        self.name, self.segment = words, segment
        self.first, self.size = np.arange(len(words)), np.ones(len(words), np.int64)
        self.low, self.high = self.first, self.first + 1
        for r in range(ROUNDS):
            if r in RUNS:
                self._runs()
            self._pairs(r)

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the reach of the symbol before starts, and that of the symbol after ends; past the ends of a segment it is unknown."""
        new = np.concatenate(([True], self.segment[1:] != self.segment[:-1]))
        before = np.where(new, -FAR, np.concatenate(([0], self.low[:-1])))
        return before, np.where(np.append(new[1:], True), FAR, np.append(self.high[1:], 0))

    def _take(self, at, name, size, low, high) -> None:
        order = np.argsort(at, kind="stable")
        self.first, self.segment = self.first[at[order]], self.segment[at[order]]
        self.name, self.size, self.low, self.high = name[order], size[order], low[order], high[order]

    def _runs(self) -> None:
        """A run that fits a symbol becomes one; that its ends are its ends, the symbols beside it show. In a longer run symbols stay, and as many of it as do not fit, up to the symbol, show that; before so many it is not known."""
        if not len(self.name):
            return
        name, size, low, high = self.name, self.size, self.low, self.high
        starts = np.concatenate(([True], (name[1:] != name[:-1]) | (self.segment[1:] != self.segment[:-1])))
        first, run = np.flatnonzero(starts), np.cumsum(starts) - 1
        k = np.diff(np.append(first, len(name)))
        last = first + k - 1
        before, after = self._beside()
        fits = k * size[first] <= CAP
        a, b, n = first[fits], last[fits], k[fits]
        sure = (n == 1) & (2 * size[a] > CAP)  # too large for any run
        named = np.where(n > 1, mix64(name[a] * _u(_P[0]) + mix64(n.astype(np.uint64))), name[a])
        own = np.flatnonzero(~fits[run])
        need = CAP // size[own] + 1
        at = own - need + 1
        known = at >= first[run[own]]
        self._take(
            np.concatenate((a, own)), np.concatenate((named, name[own])), np.concatenate((size[a] * n, size[own])),
            np.concatenate((np.where(sure, low[a], np.minimum(low[a], before[a])), np.where(known, low[at], -FAR))),
            np.concatenate((np.where(sure, high[a], np.maximum(high[b], after[b])), high[own])))

    def _pairs(self, r: int) -> None:
        """A left symbol and the right symbol after it become one where they fit. Two are all it takes; a symbol that stays alone has to see its neighbour."""
        name, size, low, high = self.name, self.size, self.low, self.high
        left = mix64(name + _u((r + 1) * _P[1])) >> np.uint64(63) == 0
        before, after = self._beside()
        pair = np.zeros(len(name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (after[:-1] < FAR) & (size[:-1] + size[1:] <= CAP)
        # the neighbour's own reach may be unknown, but then so is the pair's
        second = np.concatenate(([False], pair[:-1]))[:len(name)]
        full = size >= CAP
        new_low = np.where(~left & ~second & ~full, np.minimum(low, before), low)
        new_high = np.where(left & ~pair & ~full, np.maximum(high, after), high)
        i = np.flatnonzero(pair)
        name, size = name.copy(), size.copy()
        name[i] = mix64(name[i] * _u(_P[0]) + mix64(name[i + 1] + _u(_P[1])))
        size[i] += size[i + 1]
        new_low[i], new_high[i] = np.minimum(low[i], low[i + 1]), np.maximum(high[i], high[i + 1])
        keep = np.flatnonzero(~second)
        self._take(keep, name[keep], size[keep], new_low[keep], new_high[keep])


def _power(p: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n + 1, p & _MASK, np.uint64), dtype=np.uint64)


class Sums:
    """Hashes of any stretch of words, independent of where it stands, by prefix sums."""

    def __init__(self, words: np.ndarray, p: int):
        self.back = _power(pow(p, -1, 1 << 64), len(words))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(words ^ _u(p)) * _power(p, len(words))[:-1], dtype=np.uint64)))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.back[a])


class Windows:
    """All windows of some texts: `text` and `at` (first word in it), `chosen` (place of the symbol, or -1), and the distinct chosen symbols.

    Texts are cut in segments that overlap so that every window, and whatever its symbol looks at, lies inside one.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        cut = [(k, a, min(a + SEGMENT, n - WINDOW + 1), n) for k, n in enumerate(np.diff(bounds).tolist()) for a in range(0, n - WINDOW + 1, SEGMENT)]
        text, start, stop, n = np.array(cut, np.int64).reshape(-1, 4).T
        origin, end = np.maximum(0, start - WINDOW), np.minimum(n, stop + 2 * WINDOW)
        held = end - origin
        begin = np.cumsum(held) - held  # of each segment among the words of all
        place = np.arange(int(held.sum())) - np.repeat(begin, held)
        own_words = words[np.repeat(bounds[text] + origin, held) + place]
        self.sums = [Sums(own_words, p) for p in _P]
        segment = np.repeat(np.arange(len(cut)), held)
        shift = origin - begin  # from a place among all words to one in the text
        made = Parse(own_words, segment)

        # symbols that some window contains with their reach, as intervals of window starts
        s = made.segment
        low = np.maximum(made.high - WINDOW, begin[s])
        high = np.minimum(made.low, begin[s] + held[s] - WINDOW)
        ok = np.flatnonzero((made.high - made.low <= WINDOW) & (low <= high))
        low, high, name = low[ok], high[ok], made.name[ok]
        i = np.repeat(start - shift, stop - start) + np.arange(int((stop - start).sum())) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start)
        own = segment[i]
        self.text, self.at, self.place = text[own], i + shift[own], i
        best = _least(np.searchsorted(high, i), np.searchsorted(low, i, "right"), (np.uint64(255) - made.size[ok].astype(np.uint64) << np.uint64(56)) | (mix64(name ^ _u(_P[1])) >> np.uint64(8)))
        used = np.unique(best[best >= 0])
        k, s = ok[used], made.segment[ok[used]]
        a, b = np.maximum(made.high[k] - WINDOW, begin[s]), np.minimum(made.low[k] + WINDOW, begin[s] + held[s])
        inside = (made.first[k] - a) * 4096 + (made.low[k] - a) * 64 + (b - a)
        self.symbols = pd.DataFrame({
            "text": text[s], "start": made.first[k] + shift[s], "name": name[used].view(np.int64),
            "around": mix64(self.sums[0](a, b) + mix64(inside.astype(np.uint64))).view(np.int64)}).drop_duplicates(["text", "start"])
        self.chosen = np.where(best >= 0, (made.first[ok] + shift[made.segment[ok]])[best] if len(ok) else 0, -1)

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 128-bit hashes of the windows with these places in this object."""
        i = self.place[at]
        return tuple(sums(i, i + WINDOW).view(np.int64) for sums in self.sums)


def _least(start: np.ndarray, stop: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each range of places that of the least key, the first of several; -1 for an empty range."""
    out, span, level = np.full(len(start), -1, np.int64), 1, np.arange(len(key))
    width = stop - start
    while True:
        at = np.flatnonzero((width >= span) & (width < 2 * span))
        a, b = level[start[at]], level[stop[at] - span]
        out[at] = np.where(key[b] < key[a], b, a)
        span *= 2
        if span > width.max(initial=0):
            return out
        level = np.where(key[level[span // 2:]] < key[level[:-(span // 2)]], level[span // 2:], level[:-(span // 2)])


def _symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chosen symbols of each document; a document with windows that have none gets a row without name."""
    for pdf in batches:
        texts, ids, h = pdf["text"].tolist(), pdf["id"].to_numpy(np.int64), pdf["h"].to_numpy(np.int64)
        for lo, hi in chunks(texts, PIECE):
            found = Windows(*hashed(texts[lo:hi]))
            out = found.symbols
            yield pd.DataFrame({"id": ids[lo + out["text"]], "h": h[lo + out["text"]], "start": out["start"], "name": out["name"].astype("Int64"), "around": out["around"]})
            if len(blind := np.unique(found.text[found.chosen < 0])):
                yield pd.DataFrame({"id": ids[lo + blind], "h": h[lo + blind], "start": -1, "name": pd.array([None] * len(blind), "Int64"), "around": 0})


def _spans(starts: np.ndarray) -> np.ndarray:
    """First and last + 1 of the words that windows with these sorted starts cover, in turn."""
    if not len(starts):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.diff(starts) > WINDOW) + 1
    return np.stack([starts[np.concatenate(([0], new))], starts[np.append(new - 1, -1)] + WINDOW], 1).ravel()


def kept_text(text: str | None, spans: np.ndarray) -> tuple[int, int, str]:
    """Number of words, how many lie in the spans, and the others, joined by one space."""
    out, n = [], 0
    for piece in pieces(text):
        w = piece.encode("utf-8", "surrogatepass").split()
        if len(spans):
            cover = np.zeros(len(w) + 1, np.int64)
            edges = np.clip(spans - n, 0, len(w)).reshape(-1, 2)
            np.add.at(cover, edges[:, 0], 1), np.add.at(cover, edges[:, 1], -1)
            kept = [x for x, c in zip(w, np.cumsum(cover)[:-1].tolist()) if not c]
        else:
            kept = w
        n += len(w)
        if kept:
            out.append(b" ".join(kept))
    removed = int((spans[1::2] - spans[::2]).sum())
    return n, removed, b" ".join(out).decode("utf-8", "surrogatepass")


RESULT = "id long, none boolean, n_words long, n_removed long, removed array<int>, kept string"


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, none, *kept_text(t, np.zeros(0, np.int64))) for i, none, t in zip(pdf["id"], pdf["none"], pdf["text"])]
        out = pd.DataFrame(rows, columns=["id", "none", "n_words", "n_removed", "kept"])
        out.insert(4, "removed", [[]] * len(out))
        yield out


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with the starts of windows that are decided to go, and the hashes of open ones; those without open ones are done and lose their text."""
    for pdf in batches:
        texts = pdf["text"].tolist()
        for lo, hi in chunks(texts, PIECE):
            part = pdf.iloc[lo:hi]
            asked = [t if s is not None else None for t, s in zip(part["text"], part["states"])]
            found, rows = Windows(*hashed(asked)), []
            bounds = np.searchsorted(found.text, np.arange(len(part) + 1))
            for k, (i, none, h, text, states) in enumerate(zip(part["id"], part["none"], part["h"], part["text"], part["states"])):
                own = np.arange(bounds[k], bounds[k + 1])
                state = np.zeros(len(own), np.int64)
                if states is not None and len(own):
                    known = np.sort(np.asarray(states, np.int64))  # 4 * start + state
                    near = np.minimum(np.searchsorted(known, 4 * found.chosen[own] + 3, "right") - 1, len(known) - 1)
                    hit = (near >= 0) & (known[near] >> 2 == found.chosen[own])
                    state = np.where(found.chosen[own] < 0, OPEN, np.where(hit, known[near] & 3, 0))
                gone, left = found.at[own[state == DECIDED]], own[state == OPEN]
                n, removed, kept = kept_text(text, _spans(gone)) if not len(left) else (0, 0, None)
                rows.append((i, none, h, n, removed, gone if len(left) else _spans(gone), kept, text if len(left) else None, *found.keys(left), found.at[left]))
            yield pd.DataFrame(rows, columns=["id", "none", "h", "n_words", "n_removed", "removed", "kept", "text", "k1", "k2", "at"])


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, none, text, gone, more in zip(pdf["id"], pdf["none"], pdf["text"], pdf["removed"], pdf["more"]):
            spans = _spans(np.union1d(np.asarray(gone, np.int64), np.asarray([] if more is None else more, np.int64)))
            n, removed, kept = kept_text(text, spans)
            rows.append((i, none, n, removed, spans, kept))
        yield pd.DataFrame(rows, columns=["id", "none", "n_words", "n_removed", "removed", "kept"])


def dedup_substrings(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n_words, n_removed, removed (first word and last word + 1 of each stretch, in turn), kept (the other words, joined by one space)."""
    bounded_batches(spark)
    scratch = Scratch(spark, "substring-dedup")
    own = F.col(id_col).cast("long")
    docs = df.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("none"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))

    # symbols of more than one document
    symbols = scratch.write(docs.where("NOT none AND text IS NOT NULL").select("id", "h", "text").mapInPandas(tidy(_symbols), "id long, h long, start int, name long, around long"), "symbols")
    names = symbols.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("a"), F.max("id").alias("z"), (F.min("around") == F.max("around")).alias("alike"))
    # written, so that the join is of two plain shuffles, whose large partitions adaptive execution splits; so with the joins below
    names = scratch.write(names.where("a < z").drop("z"), "names")
    shared = scratch.write(symbols.join(names, "name"), "shared")
    # what they decide: alike everywhere, or alike in a smaller document; else the windows are open
    same = shared.where("NOT alike").groupBy("name", "around").agg(F.min("id").alias("m"))
    differ = shared.where("NOT alike").join(scratch.write(same, "same"), ["name", "around"])
    coded = lambda d, state: d.select("id", "h", (F.col("start") * F.lit(4) + state).alias("state"))
    states = coded(shared.where("alike AND a < id"), F.lit(DECIDED)).unionByName(coded(differ, F.when(F.col("m") < F.col("id"), DECIDED).otherwise(OPEN)))
    states = states.unionByName(coded(symbols.where("name IS NULL"), F.lit(OPEN)))
    states = scratch.write(states.groupBy("id", "h").agg(F.collect_set("state").alias("states")), "states")

    # documents that surely have nothing to decide stay where they are
    cell = F.pmod("h", F.lit(FILTER_CELLS))
    cells, marked = F.broadcast(states.select(cell.alias("cell")).distinct()), docs.withColumn("cell", cell)
    sure = marked.join(cells, "cell", "left_anti").select("id", "none", "text").mapInPandas(tidy(_whole), RESULT)
    asked = marked.join(cells, "cell", "left_semi").drop("cell").join(states.withColumn("none", F.lit(False)), ["id", "h", "none"], "left")
    judged = scratch.write(asked.select("id", "none", "h", "text", "states").mapInPandas(
        tidy(_judged), "id long, none boolean, h long, n_words long, n_removed long, removed array<int>, kept string, text string, k1 array<long>, k2 array<long>, at array<int>"), "judged")
    done, pending = judged.where("text IS NULL"), judged.where("text IS NOT NULL")

    # open windows, by their words
    windows = pending.select("id", "h", F.explode(F.arrays_zip("k1", "k2", "at")).alias("w")).select("id", "h", "w.k1", "w.k2", "w.at")
    owners = windows.groupBy("k1", "k2").agg(F.min("id").alias("o"), F.max("id").alias("z")).where("o < z").drop("z")
    hits = windows.join(scratch.write(owners, "owners"), ["k1", "k2"]).where("o < id").groupBy("id", "h").agg(F.collect_set("at").alias("more"))
    rest = pending.select("id", "none", "h", "text", "removed").join(hits, ["id", "h"], "left").select("id", "none", "text", "removed", "more")
    out = sure.unionByName(done.select("id", "none", "n_words", "n_removed", "removed", "kept")).unionByName(rest.mapInPandas(tidy(_finished), RESULT))
    return out.select(F.when(~F.col("none"), F.col("id")).alias(id_col), "n_words", "n_removed", "removed", "kept")


ORACLE = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, w FROM split),
started AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= n THEN array_to_string(w[i:i + 49], ' ') END AS seq FROM word),
owner AS (SELECT seq, min(doc_id) AS o FROM started WHERE seq IS NOT NULL GROUP BY seq),
flagged AS (SELECT doc_id, i, word, coalesce(o < doc_id, false) AS hit FROM started LEFT JOIN owner USING (seq)),
covered AS (SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM flagged),
summed AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM covered GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""
