"""Ranked search and tokenizer alignment against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from compare import database, same_rows
from glyphtally.llm import lexical_search as ls, token_align as ta
from glyphtally.llm import queries as Q

DATA = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, top):
    """{(item id, terms): [(document id, score)]} by brute force."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = {}
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 50 + 50 * c.total() * n // total
            if score := sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text))):
                scored.append((-score, i is None, i or 0))
        if scored:
            out[item, tuple(sorted(set(terms(text))))] = [(None if none else i, -s) for s, none, i in sorted(scored)[:top]]
    return out


DOCS = [(1, "The cat sat on the mat"), (2, "the CAT"), (2, "a cat, a mat"), (None, "cat cat Ünï ünï"), (4, None), (5, ""), (6, "... !!"), (7, "mat " * 40_000), (8, "the cat"), (9, "the cat"), (9, "the cat"),
        (10, "zebra\x00quagga ß_ß 12a"), (2**60 + 1, "quagga cat"), (11, "CAFÉ café 日本 日本語")]
ITEMS = [(1, "the cat and the mat"), (2, "cat mat"), (2, "zebra ß 12A"), (2, "mat CAT"), (None, "quagga the cat"), (None, None), (3, ""), (4, "nowhere"), (5, "the the cat on a mat 日本語 café"), (2**60 + 1, "cat")]
CLASH = ", id long, item int, score long, n long, rank int, task string, terms string"


@pytest.mark.parametrize("top", [3, 50])
def test_search_like_brute_force(spark, monkeypatch, top):
    docs = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, "t", "x") for r in DOCS], "doc_id long, text string" + CLASH)
    items = spark.createDataFrame([(*r, 1, 1, 1, 1, 1, "t", "x") for r in ITEMS], "item_id long, text string" + CLASH)
    want = sorted(map(repr, (v for v in ranked(DOCS, ITEMS, top).values())))
    for block in (1 << 16, 4):  # one block, then several
        monkeypatch.setattr(ls, "BLOCK_TERMS", block)
        got = {}
        for r in ls.lexical_search(spark, docs, items, top=top).sort("item_no", "rank").collect():
            got.setdefault((r.item_no, r.item_id), []).append((r["rank"], r.doc_id, r.score))
        assert all([k for k, _, _ in v] == list(range(1, len(v) + 1)) for v in got.values())
        assert sorted(repr([(i, s) for _, i, s in v]) for v in got.values()) == want
        assert sorted(str(i) for _, i in got) == sorted(str(i) for i, _ in ranked(DOCS, ITEMS, top))


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ls.lexical_search(spark, docs.limit(0), items).count() == ls.lexical_search(spark, docs, items.limit(0)).count() == 0


def test_search_query_like_sql(spark):
    same_rows(Q.op13_lexical_search(spark, DATA), database(), Q.ORACLES["op13_lexical_search"])


def test_graph_sums_items_and_shares_nodes():
    items = [[0, 1, 2, 3], [0, 1, 2], [1, 2, 4], [3, 5], [6], [0, 1, 2, 3]]
    graph = ls.Graph(items, 7)
    import numpy as np
    leaves = np.arange(7 * 5).reshape(7, 5) ** 2
    assert (graph.scores(leaves) == np.stack([leaves[i].sum(0) for i in items])).all()
    adds = len(graph.parts) + sum(len(e) - 1 for e in graph.ends)
    assert adds < sum(len(i) - 1 for i in items) and any(a >= 7 or b >= 7 for a, b in graph.parts)


def tokens(text, both):
    """Token ids and end bytes of A and B, by the libraries alone."""
    if not text:
        return None
    a, b = both.hub.encode(" " + text, add_special_tokens=False).ids, both.piece.encode(text)
    name = lambda i: bytes(BYTE[c] for c in both.hub.id_to_token(i))
    piece = lambda i: bytes([int(both.piece.id_to_piece(i)[3:5], 16)]) if both.piece.is_byte(i) else both.piece.id_to_piece(i).replace("▁", " ").encode()
    own = [[name(i) for i in a], [piece(i) for i in b]]
    if any(b"".join(x) != (" " + text).encode() for x in own):
        return None
    return [[(i, len(b"".join(x[:k + 1]))) for k, i in enumerate(ids)] for ids, x in zip((a, b), own)]


BYTE = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTE |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in BYTE)}


def measures(texts, both):
    """What each text gives, by brute force over all pairs of tokens."""
    cut, count = [tokens(t, both) for t in texts], Counter()
    links = [[(i, j) for i, x in c[0] for j, y in c[1] if x == y] if c else [] for c in cut]
    for own in links:
        count.update(own)
    highest = Counter()
    for (i, j), n in count.items():
        highest[j] = max(highest[j], n)
    for c, own in zip(cut, links):
        if not c:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        ends, start, groups = sorted({x for _, x in c[0]} & {y for _, y in c[1]}), 0, []
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, x in side if start < x <= end) for side in c))
            start = end
        yield (len(c[0]), len(c[1]), len(ends), len(own), sum(count[p] == highest[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest())


@pytest.mark.parametrize("broadcast", [ta.BROADCAST, 0])
def test_alignment_like_brute_force(spark, broadcast):
    both = ta.Tokenizers(ta.A_FILE, ta.B_FILE)
    texts = [None, "", " ", " leads with a space", "a  b\n\n c", "It's <|endoftext|> and <s> </s> <unk> text", "naïve café — 日本語 🙂 \x00\x7f", "▁ low line", "ｆｕｌｌ width ﬁ", "the the the", "tab\tends\t", "z" * 2500 + " end", "same text", "same text"]
    texts += [r.text[:400] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(12).collect()] + ["same text"]
    rows = [(None if k == 12 else 7 if k in (9, 10) else k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, 2, "p", 3, True) for r in rows], "doc_id long, text string, h1 long, n long, pairs string, copies int, none boolean")
    out = ta.align_tokens(spark, df, broadcast=broadcast)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *m) for (i, _), m in zip(rows, measures(texts, both))]
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))
    assert ta.align_tokens(spark, df.limit(0), broadcast=broadcast).count() == 0


def test_both_encoders_of_a_agree(spark):
    both = ta.Tokenizers(ta.A_FILE, ta.B_FILE)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + ["I'LL we'll <|endoftext|>x \x85　 ß١٢ é", "  lead", "x\n \n\t y"]
    for t in texts:
        assert both.fast(" " + t) == both.hub.encode(" " + t, add_special_tokens=False).ids


def test_pairs_count_copies(spark):
    df = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, "text")], "doc_id long, text string")
    pairs = ta.token_pairs(spark, df)
    assert pairs.agg(F.sum("n")).first()[0] == ta.align_tokens(spark, df).agg(F.sum("n_links")).first()[0] and pairs.where("best").count() == pairs.select("b").distinct().count()


ODD = [" ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "　", "​", "a", "the", " bar", "'s", "12", "é", "é", "日本", "🙂", "▁", "<s>", "<|endoftext|>", ".", "});\r", "/**\r", "\x00", "ﬁ"]


def test_words_give_what_whole_texts_give(monkeypatch):
    both, some = ta.Tokenizers(ta.A_FILE, ta.B_FILE), random.Random(3)
    texts = ["".join(some.choices(ODD + 5 * [" ", "a", "\n"], k=some.randint(1, 25))) for _ in range(1500)]
    texts += [None, "", " ", "  ", "\n ", "a ", "a  ", "a \n", " a", "z" * 2500 + " end", "a" + " " * 2500 + "b", "a\n" * 40 + " " * 30, "y " * 300]
    assert all("".join(both.words(t)) == " " + t for t in texts if t) and max(len(both.words(t)) for t in texts if t) == 300
    want = [(m[0], m[1], m[2], m[3], m[6]) for m in measures(texts, both)]
    texts, want = 3 * texts, 3 * want  # so that words come again
    seen = lambda: [(f.n_a, f.n_b, len(f.links) // 8, len(f.links) // 8, hashlib.sha256(f.groups.encode()).hexdigest()) if f else (0, 0, 0, 0, "") for f in both.align(texts)]
    assert seen() == seen() == want and both.known
    monkeypatch.setattr(ta, "KEPT", 0)  # words are forgotten again
    assert seen() == want
    both.cuts = False
    assert seen() == want
    texts = [f"{k} {k}, a{k}\n" if k % 7 else "" for k in range(100, 300)]
    both = ta.Tokenizers(ta.A_FILE, ta.B_FILE)
    assert seen() == [(m[0], m[1], m[2], m[3], m[6]) for m in measures(texts, both)] and not both.known  # words that do not: whole texts


def test_a_task_reads_equal_words_once(monkeypatch):
    read, encode = [], SentencePieceProcessor.encode
    monkeypatch.setattr(SentencePieceProcessor, "encode", lambda self, x, **k: read.append(sum(map(len, [x] if isinstance(x, str) else x))) or encode(self, x, **k))
    words = [f"word{k}," for k in range(40)]
    texts = [" ".join(random.Random(k).choices(words, k=100)) for k in range(50)]
    out = pd.concat(ta._aligned(ta.A_FILE, ta.B_FILE)(iter([pd.DataFrame({"h1": 1, "h2": 2, "copies": 1, "text": texts})] * 2)))
    assert len(out) == 100 and (out.n_a > 200).all()
    assert 0 < sum(read) < sum(map(len, texts)) / 20
