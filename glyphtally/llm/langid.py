"""Language identification by error-correcting output codes.

Each learned language has a binary codeword. For each bit a binary n-gram classifier (naive Bayes
log odds of hashed byte n-grams, languages of a side weighted alike) predicts which side a text is
on. Decoding sums, per codeword, the logistic losses of the bits, weighted by how far apart
training holds that bit's sides; the codeword with the least loss wins. The n-gram counts per language are
counted by Spark over all training rows.

A text is rejected if it is `und`, if its bits speak as much against the nearest codeword as for it (a loss of ln 2 or more, that of no evidence), or if its n-grams are
not those of the language found: their mean log probability in it falls short of the language's own mean by FAR standard deviations of a single n-gram, and by SHORT more of them
over the root of their number, since few n-grams vary more. So foreign scripts, other alphabets' languages, noise and encoded data go; program code in
English words mostly stays.

Nulls, empty texts and texts without letters: `und`, score 0, not ambiguous, rejected. Rows whose label is
null teach nothing. With no training rows at all, as in an empty table, every text is `und`. Ties in decoding go to the first
language by code point. Repeated rows count as often as they stand. Very long texts are counted whole. Only the text and, in training, the label are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, give_back, tidy

CELLS = 1 << 13
#: Share of the loss by which the second codeword must be worse, else the text is ambiguous.
CLEAR = 0.1
#: Standard deviations of an n-gram's log probability by which a text may be less likely than its language, and the part for its length.
FAR, SHORT = 1.4, 4.0
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32
_GRAMS = ((2, np.uint32(2654435761)), (3, np.uint32(2246822519)), (4, np.uint32(3266489917)))
_PAD = b" " * 4


def gram_counts(texts: list) -> Iterator[tuple[int, np.ndarray]]:
    """(first index, counts [text, cell]) of hashed byte 2- to 4-grams of whole lower-cased texts."""
    for lo, hi in chunks(texts, 1 << 18, 128):
        raw = [(t or "").lower().encode("utf-8", "replace") + _PAD for t in texts[lo:hi]]
        buf = _FOLD[np.frombuffer(b"".join(raw) + _PAD, np.uint8)].astype(np.uint32)
        doc = np.repeat(np.arange(len(raw)) * CELLS, [len(r) for r in raw])
        inside = np.ones(len(doc), bool)  # not where a gram would reach into the next text
        for k in (1, 2, 3):
            inside[np.cumsum([len(r) for r in raw]) - k] = False
        doc, inside = doc[inside], np.flatnonzero(inside)
        total = np.zeros(len(raw) * CELLS, np.int64)
        for n, factor in _GRAMS:
            code = buf[inside]
            for k in range(1, n):
                code |= buf[inside + k] << np.uint32(8 * k)
            cell = ((code * factor) >> np.uint32(19)).astype(np.int64)
            total += np.bincount(doc + cell, minlength=len(total))
        yield lo, total.reshape(len(raw), CELLS)


def codewords(languages: int) -> np.ndarray:
    """[language, bit] in -1, 1: all splits for up to five languages, else seeded codes far apart."""
    if languages <= 5:
        columns = [c for c in product((-1, 1), repeat=languages) if c and c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).reshape(len(columns), languages).T
    rng, best, apart = np.random.default_rng(7), None, -1
    bits = int(np.ceil(10 * np.log2(languages)))
    for _ in range(32):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        code = code[:, (code.max(0) == 1) & (code.min(0) == -1)].astype(np.int32)
        gram = code @ code.T
        least = int((code.shape[1] - gram[~np.eye(languages, dtype=bool)]).min()) // 2
        if least > apart:
            best, apart = code, least
    return best


class LanguageCodes:
    """Languages, their codewords, and each bit's weights per cell and scale."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages)).astype(np.float64)
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True) if len(languages) else np.zeros((0, CELLS))
        bits = self.code.shape[1] if len(languages) else 0
        self.weights = np.zeros((CELLS, bits))
        for b in range(bits):
            side = self.code[:, b] > 0
            self.weights[:, b] = np.log(share[side].mean(0)) - np.log(share[~side].mean(0))
        expected = share @ self.weights  # [language, bit]: what a text of that language scores on average
        self.middle = np.array([(expected[self.code[:, b] > 0, b].min() + expected[self.code[:, b] < 0, b].max()) / 2 for b in range(bits)])
        self.scale = np.array([np.abs(expected[:, b] - self.middle[b]).min() for b in range(bits)]) + 1e-9
        self.loss_weight = self.scale / self.scale.sum() if bits else self.scale
        self.weights = self.weights.astype(np.float32)
        logs = np.log(share)
        self.typical = (share * logs).sum(1)
        self.spread = np.sqrt(np.maximum((share * logs * logs).sum(1) - self.typical ** 2, 0))
        self.logs = logs.astype(np.float32)

    def unlike(self, counts: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Whether the n-grams of each text are too unlikely in its language."""
        n = np.maximum(counts.sum(1), 1)
        mean = (counts * self.logs[language]).sum(1, dtype=np.float64) / n
        return self.typical[language] - mean >= self.spread[language] * (FAR + SHORT / np.sqrt(n))

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Indices of languages, scores, ambiguity and rejection of texts with these counts."""
        if len(self.languages) == 1:
            only = np.zeros(len(counts), int)
            return only, np.ones(len(counts)), np.zeros(len(counts), bool), self.unlike(counts, only)
        mean = (counts.astype(np.float32) @ self.weights) / np.maximum(counts.sum(1, keepdims=True), 1)
        margin = np.clip((mean - self.middle) / self.scale, -4, 4)
        loss = np.einsum("tlb,b->tl", np.logaddexp(0, -2 * margin[:, None, :] * self.code[None]), self.loss_weight)
        best = loss.argmin(1)
        ordered = np.sort(loss, 1)
        weight = np.exp(-8 * (loss - ordered[:, :1]))
        return best, 1 / weight.sum(1), ordered[:, 1] - ordered[:, 0] < CLEAR * ordered[:, 1], (ordered[:, 0] >= np.log(2)) | self.unlike(counts, best)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, np.ndarray] = {}
    for pdf in batches:
        labels = pdf["label"].to_numpy()
        for lo, counts in gram_counts(pdf["text"].tolist()):
            own = labels[lo:lo + len(counts)]
            for label in set(own):
                held[label] = held.get(label, 0) + counts[own == label].sum(0)
    for label, total in held.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"label": label, "cell": at, "n": total[at]})


def fit_languages(df: DataFrame, label_col: str = "lang", text_col: str = "text") -> LanguageCodes:
    """Count n-grams per label over all rows and build the codes from the counts.

    The driver gets CELLS counts per label, whatever the number of rows; labels are languages, of which there are thousands at most.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    sums = rows.mapInPandas(tidy(_counted), "label string, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    languages = sorted(r[0] for r in rows.select("label").distinct().collect())
    got = sums.toPandas()
    counts = np.zeros((len(languages), CELLS))
    counts[got["label"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=int), got["cell"].to_numpy(dtype=int)] = got["n"].to_numpy()
    return LanguageCodes(languages, counts)


def language_of(model: LanguageCodes, text: Column | str) -> Column:
    """struct(lang string, score double, ambiguous boolean, rejected boolean) of a text column."""

    @F.pandas_udf("lang string, score double, ambiguous boolean, rejected boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            texts = s.tolist()
            lang, score, vague, far = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool), np.ones(len(texts), bool)
            lettered = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)
            for lo, counts in gram_counts(texts) if model.languages else ():
                own = lettered[lo:lo + len(counts)]
                best, sure, open_, off = model.decode(counts)
                at = lo + np.flatnonzero(own)
                lang[at] = np.array(model.languages, object)[best[own]]
                score[at], vague[at], far[at] = sure[own], open_[own], off[own]
            yield pd.DataFrame({"lang": lang, "score": score, "ambiguous": vague, "rejected": far})
        give_back()

    return predicted.asNondeterministic()(text)  # else a filter on the result would evaluate it twice
