"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: one trained on ordinary windows, and one
that holds the same content followed by passages typical of toxic texts (word beginnings and words in far more
toxic than ordinary documents). zstandard's own trainer was tried for the second one and found far fewer toxic documents (figures in
the README): most of what it gathers from toxic documents is ordinary language, whose chance matches drown the telling ones. A window of text that the toxic dictionary compresses
to fewer bytes than the ordinary one speaks for toxicity. A document's gains, over all windows of
its whole text, go through a logistic curve whose threshold is calibrated on the labelled sample.

Fitting reads a bounded sample of labelled rows (SAMPLE), but their whole texts, all windows of them.

Nulls and empty texts have no windows: they get the score of zero gain. Rows whose label is null
teach nothing. Without labels of both kinds, as in an empty table, every score is 0. Repeated rows score alike, and copies and near copies
teach once. Very long texts are read whole. Ties: a score of exactly 0.5 counts as toxic; typical passages in as many documents go by code point.
Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, shingle_sets

#: Labelled documents of either kind that the dictionaries and thresholds are fitted on, about.
SAMPLE = 3000
#: Smallest shingle hashes of a text that are kept to tell near copies.
SKETCH = 8
WINDOW = 72
LEVEL = 3
_WINDOWS = re.compile(r"\s*(.{1,%d}(?!\S)|\S{1,%d})" % (WINDOW, WINDOW), re.S)
_WORDS = re.compile(r"[^\W\d_]+")


def windows(text: str | None) -> list[bytes]:
    """The whole text in windows of at most WINDOW characters, cut between words where there is a gap."""
    return [b" " + w.encode("utf-8", "replace") + b" " for w in _WINDOWS.findall((text or "").lower())]


def _typical(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Words and word beginnings in many toxic documents and hardly an ordinary one, the most telling last."""

    def found(texts: list[str]) -> tuple[Counter, int]:
        seen, n, kept = Counter(), 0, set()
        for t, shingles in zip(texts, shingle_sets(texts, 3)):
            words = set(_WORDS.findall(t.lower()))
            if not words:
                continue
            sketch = shingles[:SKETCH].tolist()
            if 2 * sum(x in kept for x in sketch) >= len(sketch):  # a near copy of one that counts
                continue
            kept.update(sketch)
            n += 1
            seen.update({" " + w[:k] for w in words for k in range(4, 9) if k < len(w)} | {f" {w} " for w in words})
        return seen, max(1, n)

    in_toxic, n1 = found(toxic)
    in_ordinary, n0 = found(ordinary)
    least = max(4, 0.003 * n1)
    rated = {w: n for w, n in in_toxic.items() if n >= least and len(w) > 4 and n / n1 >= 12 * (in_ordinary[w] + 1) / n0}
    heads = {w: [w[:k] for k in range(5, len(w)) if w[:k] in rated] for w in rated}
    told = {h for w, hs in heads.items() for h in hs if rated[w] >= 0.4 * rated[h]}  # a longer passage says it as well
    return sorted((w for w in rated if w not in told), key=lambda w: (rated[w], w))


class CompressionJudge:
    """The two dictionaries and the calibrated curve."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray | None = None):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights
        self._made = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if self._made is None:
            self._made = []
            for data in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
        return self._made

    def gains(self, texts: list) -> np.ndarray:
        """[text, feature]: how many windows gain 1, 2, 3, 4 and more bytes, of how many, and the largest gain."""
        own = [windows(t) for t in texts]
        flat = [w for ws in own for w in ws]
        a, b = (np.fromiter((len(c.compress(w)) for w in flat), np.int64, len(flat)) for c in self._compressors())
        gain, ends = np.clip(a - b, -1, 6), np.cumsum([len(ws) for ws in own])
        out = np.zeros((len(texts), 9))
        for i, (lo, hi) in enumerate(zip(np.append(0, ends[:-1]), ends)):
            if hi > lo:
                h, n = np.bincount(gain[lo:hi] + 1, minlength=8), hi - lo
                out[i, :6] = np.log1p([h[2], h[3], h[4], h[5:].sum(), n - 1, h[3:].sum()])
                out[i, 6:] = h[2:].sum() / n, h[3:].sum() / n, gain[lo:hi].max()
        return out

    def score(self, texts: list) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.gains(texts) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> CompressionJudge:
    """Fit on a bounded sample of the labelled rows: about SAMPLE documents of either kind, by the hash of the id.

    The ids are drawn from the labels alone; only the drawn ones are broadcast to fetch their texts.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("seed"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return CompressionJudge(b"", b"")
    part = F.pmod(F.xxhash64("seed"), F.lit(1_000_000))
    share = F.when(F.col("label") == 1, F.lit(int(1e6 * SAMPLE / sizes[1]))).otherwise(F.lit(int(1e6 * SAMPLE / sizes[0])))
    drawn = known.where(part < share).dropDuplicates(["seed"])
    texts = docs.select(F.col(id_col).alias("seed"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    got = texts.join(F.broadcast(drawn), "seed").toPandas().sort_values(["seed", "text"], kind="stable")
    toxic, ordinary = (list(dict.fromkeys(got.loc[got["label"] == k, "text"])) for k in (1, 0))

    fit, tune = slice(0, None, 2), slice(1, None, 2)
    plain = [w for t in ordinary[fit] for w in windows(t)]
    try:
        base = zstandard.train_dictionary(16_384, plain).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        base = b"".join(plain)[-16_384:].ljust(8, b" ")
    words = _typical(toxic[fit] if len(toxic) > 200 else toxic, ordinary[fit] if len(ordinary) > 200 else ordinary)
    judge = CompressionJudge(base, base + "".join(words).encode("utf-8", "replace"))
    x = judge.gains(toxic[tune] + ordinary[tune])
    y = np.array([1.0] * len(toxic[tune]) + [0.0] * len(ordinary[tune]))
    judge.weights = _logistic(x, y)
    return judge


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; toxic rows weigh a quarter, so clean ones are left alone."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.25 / max(1, y.sum()), 0.75 / max(1, (1 - y).sum())) * len(y)
    w, ridge = np.zeros(x.shape[1]), np.diag([0.5] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (share * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity_of(judge: CompressionJudge, text: Column | str) -> Column:
    """Score double, 0 to 1, of a text column; whole texts are compressed window by window."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.tolist()
            yield pd.Series(np.concatenate([judge.score(texts[k:k + 64]) for k in range(0, len(texts), 64)]) if texts else np.zeros(0))
        give_back()

    return scored(text)
