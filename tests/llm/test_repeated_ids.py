"""Rows that share an id but not their content, and rows without id."""

import random

import numpy as np

import corpus_pipeline
from glyphtally.llm import lattice_dedup as lat, mixture, ngram_join as ng


def text(seed, n=80):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def test_texts_that_share_an_id(spark):
    """Links, classes and components go by content; the smallest id names them."""
    t1, t2, t3 = text(1), text(2), text(3)
    rows = [(5, t1), (5, t2), (7, t1 + " more"), (8, t2), (9, t3), (5, t3 + " and more"), (5, t1), (None, t1), (None, t2 + " x")]
    out = ng.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), count_links=True)
    got = sorted(((r.doc_id, r.n_shingles, r.class_id, r.component_id, r.n_links) for r in out.collect()), key=repr)
    want = [(5, 76, 5, 5, 2), (5, 76, 5, 5, 2), (7, 77, 7, 5, 2), (5, 76, 5, 5, 1), (8, 76, 5, 5, 1), (9, 76, 9, 5, 1), (5, 78, 5, 5, 1), (None, 76, None, None, 0), (None, 77, None, None, 0)]
    assert got == sorted(want, key=repr)


def test_near_copies_stage_with_shared_ids(spark):
    """A row goes when its own text is a near copy of a smaller id's, not when another row with its id is."""
    t1, t2 = text(1), text(2)
    rows = [(3, t1, "a"), (5, t1 + " more", "a"), (5, t2, "a"), (None, t1, "a"), (None, t1, "b")]
    docs = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted((str(r.doc_id), r.text == t2) for r in kept.collect()) == [("3", False), ("5", True), ("None", False), ("None", False)]


def test_vectors_that_share_an_id(spark):
    r = np.random.default_rng(3)
    a, b, c = r.normal(size=(3, 32))
    near = lambda v: v + r.normal(size=32) * 0.02
    rows = [(1, a), (1, b), (2, near(a)), (3, c), (1, a), (4, near(b)), (4, near(c)), (None, a)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    unit = [v / np.linalg.norm(v) for _, v in rows]
    got = sorted(map(repr, (tuple(x) for x in lat.near_duplicate_vectors(spark, df).collect())))
    link = [[j for j in range(7) if j != i and unit[i] @ unit[j] >= 0.9] if i < 7 else [] for i in range(8)]
    component = {0: 1, 2: 1, 4: 1, 1: 1, 5: 1, 3: 3, 6: 3, 7: None}
    want = [(i, len(link[k]), component[k], None if component[k] is None else i == component[k]) for k, (i, _) in enumerate(rows)]
    assert got == sorted(map(repr, want))


def test_mixing_rows_without_ids(spark):
    """Rows without id are places of their own in the seeded order, so targets are met as with ids."""
    r = random.Random(7)
    rows = [(None if k % 2 else k % 40, " ".join(["w"] * r.randint(1, 5) + [f"t{k}"]), "ab"[k % 2 if k < 300 else 0]) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixture.mix_sources(spark, df, weights=(1, 5)).toPandas()
    target = plan.groupby("source")["target"].first()
    taken = mixture.repeated(spark, df, weights=(1, 5)).toPandas()
    words = taken["text"].str.split().str.len().groupby(taken["source"]).sum()
    for source in "ab":
        assert abs(words[source] - target[source]) <= 6 and abs(plan.loc[plan["source"] == source, "taken"].sum() - target[source]) <= 1
