"""The trees of op1_ngram_jaccard_join: how often pairs leave them, and links that only they find."""

from __future__ import annotations

import random

import pytest

from glyphtally.llm import ngram_join as ng


@pytest.fixture
def made(spark, monkeypatch):
    """Counts the pairs that leave the trees; eight partitions that are not put together."""
    total, plain = spark.sparkContext.accumulator(0), ng._buckets

    def counted(pct):
        run = plain(pct)

        def go(batches):
            for out in run(batches):
                total.add(len(out))
                yield out

        return go

    monkeypatch.setattr(ng, "_buckets", counted)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield total
    for k, v in before.items():
        spark.conf.set(k, v)


def test_pairs_do_not_leave_the_trees_for_every_token(spark, made):
    base, rows = [f"w{i}" for i in range(420)], []
    for d in range(10):  # a passage of its own each: similarity 0.73, near, but no links
        at = 10 + 40 * d
        rows.append((d, " ".join(base[:at] + [f"x{d}_{i}" for i in range(28)] + base[at + 28:])))
    got = {r.doc_id: r.component_id for r in ng.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d for d in range(10)}
    assert 0 < made.value <= 2 * 45


@pytest.mark.parametrize("block", [1, 1024])  # single buckets, buckets laid together
def test_links_between_texts_whose_first_class_is_another(spark, monkeypatch, made, block):
    monkeypatch.setattr(ng, "BLOCK", block)
    texts = [[f"w{d}_{i}" for i in range(40)] for d in range(30)]
    rows = [(0, " ".join(w for t in texts for w in t))]  # holds all texts, links with none
    rows += [(1 + d, " ".join(t)) for d, t in enumerate(texts)] + [(101 + d, " ".join(t[:-1] + ["y"])) for d, t in enumerate(texts)]
    got = {r.doc_id: (r.component_id, r.n_links) for r in ng.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), count_links=True).collect()}
    assert got == {i: ((i - 100 if i > 100 else i), int(i > 0)) for i, _ in rows}
    assert made.value > 0


def test_what_the_join_shuffles(spark):
    """Texts are shuffled to be verified and not their sets; count vectors are compressed, bucket keys have 40 bits."""
    rng = random.Random(5)
    rows, heard = [], spark.sparkContext._jsc.sc().statusStore()
    for g in range(100):
        words = [f"w{rng.randrange(3000)}" for _ in range(600)]
        for c in range(4):
            at = rng.randrange(590)
            rows.append((4 * g + c, " ".join(words[:at] + [f"x{g}_{c}"] + words[at + 1:])))

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = heard.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = written()
    got = {r.doc_id: r.component_id for r in ng.ngram_jaccard_join(spark, docs).collect()}
    moved = written() - before
    assert got == {i: i - i % 4 for i, _ in rows}
    assert moved < 5.6 * sum(len(t) for _, t in rows), moved / sum(len(t) for _, t in rows)
