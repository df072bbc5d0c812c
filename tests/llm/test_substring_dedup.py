"""Removal of repeated passages against brute force, and on odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import database, same_rows
from glyphtally.llm import queries as Q
from glyphtally.llm import substring_dedup as sd

DATA = "/root/testdata/sf0.001"
CLASH = ", h long, start int, name string, k1 long, state int, none boolean, kept string, cell int"


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out


def removed(rows):
    """(id, words, removed, kept) by brute force over all windows."""
    owner = {}
    cut = [split(t) for _, t in rows]
    for (i, _), w in zip(rows, cut):
        for k in range(len(w) - 49):
            if i is not None:
                owner[key] = min(owner.get(key := tuple(w[k:k + 50]), i), i)
    for (i, _), w in zip(rows, cut):
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and owner[tuple(w[k:k + 50])] < i:
                gone |= set(range(k, k + 50))
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


def corpus(seed):
    r = random.Random(seed)
    fresh = lambda n, of: [r.choice(of) for _ in range(n)]
    many, two = [f"w{k}" for k in range(500)], ["a", "b"]
    passages = [fresh(n, many) for n in (49, 50, 51, 60, 120, 400)] + [fresh(90, two), ["a"] * 130, ["a", "b"] * 70, ["x", "y", "z"] * 60, fresh(30, two) * 4]
    texts = []
    for k in range(70):
        w = fresh(r.choice((0, 3, 20, 80)), many)
        for _ in range(r.randint(1, 3)):
            p = list(r.choice(passages))
            if r.random() < 0.4:
                p = p[r.randint(0, 20):len(p) - r.randint(0, 20)]
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "edit"
            w += p + fresh(r.choice((0, 1, 15, 60)), two if r.random() < 0.2 else many)
        texts.append(r.choice((" ", "  ", "\t", "\n\n", "\x0b ")).join(w))
    texts += [None, "", " \n", "one", " ".join(passages[1]), " ".join(passages[1]).upper(), " ".join(["a"] * 50), " ".join(["a"] * 49), " ".join(["a"] * 3000), " ".join(passages[3]), " ".join(passages[4] * 9)]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts))
    return rows + [rows[5], rows[5], (rows[6][0], rows[7][1]), (None, texts[9]), (None, " ".join(passages[5])), (10**15 + 1, texts[9] + " tail")]


@pytest.mark.parametrize("seed,segment", [(1, 1 << 17), (2, 64)])
def test_like_brute_force(spark, monkeypatch, seed, segment):
    monkeypatch.setattr(sd, "SEGMENT", segment)
    monkeypatch.setattr(sd, "PIECE", 1 << 18 if segment > 64 else 200)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2, "n", 3, 4, True, "k", 5) for r in rows], "doc_id long, text string" + CLASH)
    out = sd.dedup_substrings(spark, df)
    got = sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in out.collect())
    assert got == sorted(map(repr, removed(rows)))
    assert out.where("n_removed <> coalesce(aggregate(removed, 0, (s, x) -> x - s), 0)").count() == 0  # ends minus starts
    assert sd.dedup_substrings(spark, df.limit(0)).count() == 0


def test_query_like_sql(spark):
    same_rows(Q.op12_substring_dedup(spark, DATA), database(), Q.ORACLES["op12_substring_dedup"])


@pytest.mark.parametrize("seed", range(6))
def test_choice_is_a_property_of_the_window(seed, monkeypatch):
    """Equal windows choose the same symbol at the same place in them, whatever stands around them and however texts are cut."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range((2, 3, 5, 30, 300, 300)[seed])]
    passages = [[r.choice(words) for _ in range(r.randint(50, 130))] for _ in range(4)] + [["w0"] * 70, ["w0", "w1"] * 40]
    texts = [[r.choice(words) for _ in range(r.randint(0, 90))] for _ in range(40)]
    texts = [" ".join(t + r.choice(passages) + t[::-1] + r.choice(passages)) for t in texts]
    seen = {}
    for segment in (1 << 17, 40):
        monkeypatch.setattr(sd, "SEGMENT", segment)
        found = sd.Windows(*sd.hashed(texts))
        assert len(found.at) == sum(len(t.split()) - 49 for t in texts)
        k1, k2 = found.keys(np.arange(len(found.at)))
        symbols = {(t, s): (name, around) for t, s, name, around in found.symbols.itertuples(index=False)}
        for t, at, chosen, *key in zip(found.text, found.at, found.chosen, k1, k2):
            mine = (None, None) if chosen < 0 else (chosen - at, symbols[t, chosen][0])
            assert seen.setdefault(tuple(key), mine) == mine
            assert seen.setdefault((t, at), (chosen, symbols.get((t, chosen)))) == (chosen, symbols.get((t, chosen)))


def test_symbols_are_few(spark):
    """Fewer chosen symbols than a tenth of the windows, few windows without one, and long symbols."""
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("text")).collect()]
    found = sd.Windows(*sd.hashed(texts))
    assert len(found.symbols) < 0.1 * len(found.at) and (found.chosen < 0).mean() < 0.01
