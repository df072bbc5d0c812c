"""The operators of the corpus subpackage against brute force, and on odd rows."""

import random
import re
import tempfile
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphtally.llm import common, decontaminate as dec, html_main, langid, lattice_dedup as lat, line_dedup, mixture, ngram_join as ng, shard_pack as sp, token_order as to, toxicity
from glyphtally.llm import queries as Q

DATA = "/root/testdata/sf0.001"
# columns of the input that share names with columns the operators use inside
CLASH = "doc_id long, text string, lang string, source string, id long, token long, n long, component string, cell int, hash string, item string, size int, v string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def edited(text, seed, k):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    base, long = words(1, 120), words(2, 9000)
    texts = [None, "", " \t\n", "one", "one two three", "ONE two THREE", base, base, base.upper(), *[edited(base, k, 3) for k in range(12)],
             *[edited(base, 50 + k, 9) for k in range(6)], long, edited(long, 3, 200), words(5, 60), words(6, 60) + " " + " ".join(base.split()[:50]), "!!! *** 123", "a b c d e", "a b c d e"]
    out = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3 if i else 2]) for i, t in enumerate(texts)]
    return out + [out[6], out[1]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "c", 4, "h", "i", 5, "v") for r in rows], CLASH)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def reached(links):
    """The smallest node that each reaches over symmetric links."""
    out = {}
    for k in sorted(links):
        todo = [k] if k not in out else []
        while todo:
            j = todo.pop()
            if j not in out:
                out[j] = k
                todo += links[j]
    return out


def linked(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and i and 100 * i >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def small_blocks(monkeypatch):
    for name, size in (("BLOCK", 4), ("PARTNERS", 2), ("BLOCK_SETS", 5), ("BLOCK_TOKENS", 3000)):
        monkeypatch.setattr(ng, name, size)


def test_ngram_join(spark, docs, rows, monkeypatch):
    small_blocks(monkeypatch)
    sets = {r[0]: shingles(r[1]) for r in rows}
    want = linked(sets)
    got = ng.ngram_jaccard_join(spark, docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]) for r in got)


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join_counts_all_links(spark, docs, rows, small, monkeypatch):
    if small:
        small_blocks(monkeypatch)
    sets = {r[0]: shingles(r[1]) for r in rows}
    near = lambda x, y: bool(x & y) and 100 * len(x & y) >= 75 * len(x | y)
    want = {i: sum(near(s, sets[r[0]]) for r in rows) - bool(s) for i, s in sets.items()}
    got = ng.ngram_jaccard_join(spark, docs, count_links=True).collect()
    assert len(got) == len(rows) and {r.doc_id: r.n_links for r in got} == want and max(want.values()) > 5
    assert {r.doc_id: r.component_id for r in got} == linked(sets)
    first = {k: min(i for i in sets if sets[i] == sets[k]) for k in sets if sets[k]}
    pairs = {(a, b) for a in set(first.values()) for b in set(first.values()) if a < b and near(sets[a], sets[b])}
    assert {tuple(r) for r in ng.ngram_jaccard_links(spark, docs).collect()} == pairs


BIG = 1 << 60


def with_null_ids(spark, values, name):
    """Rows whose ids do not fit a double, with a null id between them, all in one partition."""
    rows = [(BIG + 1, values[0]), (None, values[1]), (BIG + 3, values[2]), (BIG + 5, values[0])]
    return spark.createDataFrame(rows, f"{name}").coalesce(1)


def test_null_ids_leave_other_ids_alone(spark):
    base, long = words(1, 120), words(2, 150)
    docs = with_null_ids(spark, [base, base, long], "doc_id long, text string").union(spark.createDataFrame([(BIG + 7, edited(base, 1, 3))], "doc_id long, text string")).coalesce(1)
    got = {r.doc_id: (r.component_id, r.n_links, r.n_shingles) for r in ng.ngram_jaccard_join(spark, docs, count_links=True).collect()}
    assert got == {BIG + 1: (BIG + 1, 2, 116), None: (None, 0, 116), BIG + 3: (BIG + 3, 0, 146), BIG + 5: (BIG + 1, 2, 116), BIG + 7: (BIG + 1, 2, 116)}


def test_null_ids_leave_other_vectors_alone(spark):
    v = [float(x) for x in np.random.default_rng(5).standard_normal(16)]
    df = with_null_ids(spark, [v, v, [x + 0.01 for x in v]], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lat.near_duplicate_vectors(spark, df).collect()}
    assert got == {BIG + 1: (2, BIG + 1), None: (0, None), BIG + 3: (2, BIG + 1), BIG + 5: (2, BIG + 1)}


def test_null_ids_leave_other_sequences_alone(spark, tmp_path):
    df = with_null_ids(spark, ["one two", "three", "four five six"], "doc_id long, text string")
    count = {}
    for r in to.materialise_training_order(spark, df, root=f"file://{tmp_path}/s", length=2, per_shard=3).collect():
        count.setdefault(r.doc_id, []).append(r.n_tokens)
    assert count.keys() == {BIG + 1, None, BIG + 3, BIG + 5} and sum(count[BIG + 1]) == sum(count[BIG + 5]) == len(to.Tokens(to.VOCABULARY)("one two"))
    assert sum(count[BIG + 3]) == len(to.Tokens(to.VOCABULARY)("four five six"))


def test_ngram_join_empty(spark, docs):
    assert ng.ngram_jaccard_join(spark, docs.where("false")).count() == 0
    assert [r.component_id for r in ng.ngram_jaccard_join(spark, docs.where("text IS NULL")).collect()] == [0]


def test_count_tree():
    r = np.random.default_rng(0)
    p = r.poisson(2, (400, 64))
    p[200:] = np.maximum(0, p[:200] + r.integers(-1, 2, (200, 64)) * (r.random((200, 64)) < 0.2))
    n = p.sum(1)
    got = set(zip(*ng.CountTree(p).search(p, 75)))
    assert got == {(i, j) for i in range(400) for j in range(400) if np.minimum(p[i], p[j]).sum() >= ng.needed(n[i], n[j], 75) and 75 * max(n[i], n[j]) <= 100 * min(n[i], n[j])}


def test_fine_groups_bound():
    a, b = (np.random.default_rng(k).poisson(4, 1024 * k).astype(np.uint8) for k in (1, 4))
    assert ng.fine_minima(a.tobytes(), b.tobytes()) == np.minimum(a, b.reshape(1024, 4).sum(1)).sum()


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r.node: r.component for r in common.connected(common.Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long"), "a", "b", "x").collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 102: 100}


ITEM = "Maria Lopez walked 12 km from the old mill to the harbour and paid 40 euros for a boat that sailed the next morning"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, words(77, 40))], "item_id long, text string")
    other = ITEM.replace("Maria Lopez", "Chen").replace("12 km", "55 miles").replace("40 euros", "7 dollars")
    torn = "He paid 12 coins and 12 notes for the old mill and the harbour, then 12 more for the boat and the sail"
    bench = bench.union(spark.createDataFrame([(6, torn)], bench.schema))
    texts = {10: words(9, 30) + ". " + ITEM + ". " + words(10, 30), 11: words(11, 30) + ". " + other + " " + words(12, 5), 12: words(13, 200), 13: None, 14: "", 15: words(77, 40), 16: " ".join(ITEM.split()[:9]) + " " + words(3, 50),
             17: torn.replace("12 coins", "3 coins").replace("12 notes", "4 notes").replace("12 more", "5 more"), 18: torn.replace("12", "88")}
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, window int")
    got = {(r.doc_id, r.item_id): r.kind for r in dec.contaminated(spark, docs, bench).collect()}
    assert got == {(10, 1): "verbatim", (11, 1): "reparameterised", (15, 5): "verbatim", (18, 6): "reparameterised"}
    assert {r.doc_id for r in dec.decontaminate(spark, docs, bench).collect()} == set(texts) - {10, 11, 15, 18}
    assert dec.contaminated(spark, docs.where("false"), bench).count() == 0
    assert dec.contaminated(spark, docs, bench.where("false")).count() == 0


def test_decontamination_of_documents_without_id(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([(BIG + 1, ITEM), (None, ITEM), (None, words(4, 60)), (BIG + 3, words(5, 60))], "doc_id long, text string").coalesce(1)
    assert [(r.doc_id, r.item_id) for r in dec.contaminated(spark, docs, bench).orderBy("doc_id").collect()] == [(None, 1), (BIG + 1, 1)]
    assert {r.text for r in dec.decontaminate(spark, docs, bench).collect()} == {words(4, 60), words(5, 60)}


@pytest.mark.parametrize("names", ["Maria Lopez", "Łucja Straße"])
def test_decontamination_in_any_case(spark, names):
    item = ITEM.replace("from", "with Ana Ruiz from").replace("Maria Lopez", "Then " + names)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("12 km", "55 miles").replace("40 euros", "7 dollars")
    texts = {1: words(1, 30) + " " + item.upper() + " " + words(2, 30), 2: item.lower(), 3: item.title(), 4: words(3, 30) + "\n" + other.upper(), 5: other.lower(), 6: words(4, 90).upper(), 7: item}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.kind, r.coverage) for r in dec.contaminated(spark, docs, bench).collect()}
    assert {k: got[k] for k in (1, 2, 3, 7)} == {k: ("verbatim", 1.0) for k in (1, 2, 3, 7)}
    assert {k: v[0] for k, v in got.items() if k not in (1, 2, 3, 7)} == {4: "reparameterised", 5: "reparameterised"}


def test_decontamination_of_parts_and_numbers(spark):
    long = words(21, 59)
    sums, people = "12 + 7 = 19 and 19 - 4 = 15 so 15 x 3 = 45", "Ana Ruiz Maria Lopez Bo Chen Eva Lind Ian Moe"
    bench = spark.createDataFrame([(1, long), (2, sums), (3, people), (4, "Oslo Rome Lima"), (5, "77")], "item_id long, text string")
    part = " ".join(long.split()[10:40])
    texts = {1: words(22, 30) + " " + part + " " + words(23, 30), 2: words(24, 30) + " " + sums + " " + words(25, 9), 3: "There were " + people + " " + words(26, 9),
             4: " ".join(long.split()[5:17]) + " " + words(27, 9), 5: sums.replace("7", "8").replace("19", "20"), 6: "We saw Oslo, Rome, Lima."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in dec.contaminated(spark, docs, bench).collect()}
    assert got == {(1, 1): "verbatim", (2, 2): "verbatim", (3, 3): "verbatim"}
    assert {(r.doc_id, r.item_id) for r in dec.contaminated(spark, docs, bench, least=1).collect()} == set(got) | {(6, 4)}
    assert (4, 1) in {(r.doc_id, r.item_id) for r in dec.contaminated(spark, docs, bench, run=12).collect()}


def test_templates():
    (_, token, value, literal), = dec.templates(["We met Anna Maria in 2020. The 5 kg bag"])
    assert list(literal) == [True, True, False, True, False, True, False, False, True] and (value[literal] == 0).all()
    assert token[4] == dec.NUMBER and token[2] == dec.NAME and token[7] == dec.UNIT


def test_language(spark, docs):
    con = spark.read.parquet(f"{DATA}/documents.parquet")
    out = Q.op3_language_id(spark, DATA).join(con.select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg(F.col("lang").eqNullSafe(F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    assert out.where("score < 0 OR score > 1").count() == 0
    model = langid.fit_languages(docs)
    got = {r.doc_id: r.p for r in docs.select("doc_id", langid.language_of(model, "text").alias("p")).collect()}
    assert [got[k].lang for k in (0, 1, 2)] == ["und"] * 3 and got[0].score == 0 and got[3].lang in ("en", "de")
    assert [got[k].rejected for k in (0, 1, 2, 3)] == [True] * 3 + [False]
    assert Q.op3_language_id(spark, DATA).where("held_out IS NULL OR (rejected AND lang_pred <> 'und')").count() == 0
    none = langid.fit_languages(docs.where("false"))
    assert {r[0] for r in docs.select(langid.language_of(none, "text")["lang"]).collect()} == {"und"}


def test_codewords():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n).astype(int)
        assert len(code) == n and min(np.abs(code[i] - code[j]).sum() // 2 for i in range(n) for j in range(i)) >= (1 if n == 2 else 2 if n < 6 else 8)


def test_features_do_not_depend_on_neighbours():
    texts = ["Hello there", "", "été", words(1, 300)]
    alone = np.concatenate([next(langid.gram_counts([t]))[1] for t in texts])
    assert (alone == next(langid.gram_counts(texts))[1]).all()


def test_toxicity(spark, docs):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    text = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = Q.op4_toxicity(spark, sf).join(labels, "doc_id").join(text, "doc_id").where("held_out").toPandas()
    clean, bad = got[got.toxic == 0], got[got.toxic == 1]
    assert (clean.score < 0.5).mean() >= 0.9 and got.score.between(0, 1).all() and (bad.score >= 0.5).mean() >= 0.6
    blank = toxicity.fit_toxicity(docs, docs.select("doc_id", F.lit(0).alias("toxic")))
    assert {r[0] for r in docs.select(toxicity.toxicity_of(blank, "text")).collect()} == {0.0}
    tiny = toxicity.fit_toxicity(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert docs.select(toxicity.toxicity_of(tiny, "text").alias("s")).where("s BETWEEN 0 AND 1").count() == docs.count()


def test_windows_hold_the_whole_text():
    text = words(4, 500) + " " + "x" * 400
    assert b"".join(toxicity.windows(text)).replace(b" ", b"") == text.replace(" ", "").encode()


def test_line_dedup(spark):
    from compare import database, same_rows
    same_rows(Q.op5_line_dedup(spark, DATA), database(), line_dedup.oracle())
    pages = [(k, "https://a.org/x", f"<p>menu</p><p>own {k}</p><p>menu</p>") for k in range(5)] + [(8, None, "<p>menu</p>"), (9, "https://b.org", "<p>menu</p>"), (10, "https://a.org", None), (11, "bad", "")]
    df = spark.createDataFrame([(*p, 0, "k") for p in pages], "page_id long, url string, html string, kept int, lines string")
    got = {r.page_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_page_lines(df).collect()}
    assert got == {k: (3, 2, f"own {k}") for k in range(5)} | {8: (1, 0, "menu"), 9: (1, 0, "menu"), 10: (0, 0, ""), 11: (0, 0, "")}
    assert line_dedup.dedup_page_lines(df.where("false")).count() == 0


def test_line_dedup_is_native(spark):
    plan = Q.op5_line_dedup(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_best_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        fits = [(left, k) for k, left in enumerate(bins) if left >= s]
        k = min(fits)[1] if fits else len(bins)
        bins += [capacity] * (not fits)
        bins[k] -= s
        out.append(k)
    return out


def one_by_one(runs):
    """Bins of groups of each size in the order in which they are taken."""
    return [(size, bin_) for size, bin_, taken in runs for _ in range(taken)]


def test_best_fit():
    r = random.Random(3)
    for most in (60, 9, 100):
        for _ in range(10):
            sizes = sorted((r.randint(1, most) for _ in range(200)), reverse=True)
            runs = sp.best_fit_decreasing(sorted(Counter(sizes).items(), reverse=True), 100)
            assert one_by_one(runs) == list(zip(sizes, brute_best_fit(sizes, 100)))
    runs = sp.pack_evenly(sorted(Counter(sizes).items(), reverse=True), 7)
    held = Counter()
    for size, bin_, taken in runs:
        held[bin_] += size * taken
    assert max(held.values()) - min(held.values()) <= 100 and sum(held.values()) == sum(sizes) and set(held) <= set(range(7))


def test_every_group_is_packed_by_best_fit(spark, monkeypatch):
    monkeypatch.setattr(sp, "RUN", 3)
    texts = ["x" * (k % 13) + str(k) for k in range(90)] + ["same text"] * 20 + [None, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sp.pack_shards(spark, docs, shards=None, capacity=200).toPandas()
    groups = {}
    for t in texts:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 8
    sizes = sorted(groups.values(), reverse=True)
    bins = brute_best_fit(sizes, max(sizes[0], 200))
    want = Counter(zip(bins, sizes))
    shard = dict(zip(got.doc_id, got["shard"]))
    assert Counter((shard[texts.index(t)], n) for t, n in groups.items()) == want


@pytest.mark.parametrize("run", [sp.RUN, 3])
def test_shards(spark, docs, rows, run, monkeypatch):
    monkeypatch.setattr(sp, "RUN", run)
    got = sp.pack_shards(spark, docs, shards=4).toPandas()
    assert sorted(got.doc_id) == sorted(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    assert all(s == len((text[i] or "").encode()) + 8 and c == zlib.crc32((text[i] or "").encode()) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32))
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got.assign(t=got.doc_id.map(text).fillna("\0null")).groupby("t").shard.nunique().max() == 1
    assert sp.pack_shards(spark, docs.where("false"), shards=4).count() == 0
    few = sp.pack_shards(spark, docs, shards=None, capacity=60_000).toPandas().groupby("shard")["size"].sum()
    assert few.max() <= 60_000


def unit(v):
    return v / np.linalg.norm(v)


@pytest.mark.parametrize("small", [lat.SMALL, 2])
def test_lattice(spark, small, monkeypatch):
    monkeypatch.setattr(lat, "CELL_BLOCK", 5)
    monkeypatch.setattr(lat, "SMALL", small)
    r = np.random.default_rng(1)
    base = [r.standard_normal(24) for _ in range(60)]
    vectors = [(k, [float(x) for x in v]) for k, v in enumerate(base)]
    vectors += [(100 + k, [float(x) for x in unit(base[k % 12]) + r.standard_normal(24) * 0.04]) for k in range(80)]
    vectors += [(200, vectors[0][1]), (201, [2 * x for x in vectors[0][1]]), (300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [None] + [1.0] * 23), (304, []), (305, [float("inf")] + [1.0] * 23), (306, [1.0] * 7)]
    df = spark.createDataFrame([(*v, 1, "c") for v in vectors], "vec_id long, embedding array<double>, id int, cell string")
    got = {r.vec_id: r for r in lat.near_duplicate_vectors(spark, df).collect()}
    good = {k: unit(np.array(v)) for k, v in vectors if k < 300}
    want = {k: {j for j in good if j != k and good[k] @ good[j] >= 0.9} for k in good}
    found = sum(got[k].n_links for k in good)
    assert found >= 0.9 * sum(map(len, want.values())) and all(got[k].n_links <= len(want[k]) for k in good)
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k in got if k >= 300) and len(got) == len(vectors)
    if found == sum(map(len, want.values())):
        assert {k: got[k].component_id for k in good} == reached(want)
    assert lat.near_duplicate_vectors(spark, df.where("false")).count() == 0


def test_e8():
    x = np.random.default_rng(2).uniform(-2, 2, (200, 8))
    p = lat.decode_e8(x)
    assert np.allclose((2 * p) % 1, 0) and ((p.sum(1) % 2) == 0).all() and ((x - p) ** 2).sum(1).max() <= 1 + 1e-9
    assert (((x - p) ** 2).sum(1)[:, None] <= ((x[:, None] - p[:, None] - lat.ROOTS[None]) ** 2).sum(2) + 1e-9).all()


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="wrap"><div class="menu"><a href=x>a</a></div><div class="content"><h2>Title</h2><div>
<p>First  para, with commas, and <b>bold</b>&nbsp;text.</p><p>Second &lt;b&gt; &eacute;.<p>Third<br>line</div><div class="cookie-notice">We use cookies</div><form><p>mail me</p></form></div>
<div class="sidebar"><p>side, side, side</p></div><section id="comments"><p>Nice post, really, I like it, very, much</p></section></div><footer>foot</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_html(spark):
    want = "Title\n\nFirst para, with commas, and bold text.\n\nSecond <b> é.\n\nThird line"
    assert html_main.main_text(PAGE) == want
    deep = "<div>" * 3000 + "<p>deep down, here</p>" + "</div>" * 3000
    for page, text in ((None, ""), ("", ""), ("   ", ""), ("<div></div>", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), (deep, "deep down, here"), ("<p>open <!-- never closed", "open"), ("<html><head><title>t</title><meta name=a><body><p>told, at last", "told, at last"), ("<article><p>" + "w, " * 100000 + "</p></article>", ("w, " * 100000).strip())):
        assert html_main.main_text(page) == text
    df = spark.createDataFrame([(PAGE,), (None,)], "html string").select(html_main.main_text_of("html").alias("t"))
    assert [r.t for r in df.collect()] == [want, ""]


@pytest.mark.parametrize("piece", ['<a "', "<a b='", "<", "</script", "<a x='>", "<b><p>"])
def test_html_reads_broken_pages_in_one_pass(piece):
    began = time.process_time()
    html_main.main_text(piece * (200_000 // len(piece)))
    assert time.process_time() - began < 4


def test_html_keeps_what_only_sounds_alike():
    page = '<body><main><div class="info"><p>Facts, here.</p></div><div class="share-price"><p>Up, by two.</p></div><div class="search-results-study"><p>A, b.</p></div><div class="share-buttons"><p>tweet</p></div></main></body>'
    assert html_main.main_text(page) == "Facts, here.\n\nUp, by two.\n\nA, b."
    assert html_main.main_text("<p title=it's>one</p><p>two it's</p>") == "one\n\ntwo it's"


def test_html_of_made_pages():
    """Pages put together from blocks of known kinds: the article's blocks come back, in order, and nothing else."""
    r = random.Random(11)
    junk = ["<nav><a href=/>{}</a></nav>", "<div class=ad>{}</div>", "<aside><p>{}</p></aside>", '<div class="cookie-notice"><p>{}</p></div>', "<form><p>{}</p></form>", "<script>{}</script>", "<!-- {} -->", '<section id="comments"><p>{}</p></section>']
    for k in range(60):
        own = [f"{words(1000 * k + j, r.randint(12, 40))}, and more, {j}." for j in range(r.randint(2, 6))]
        body = "".join(f"<p>{x}</p>" + (r.choice(junk).format(words(j, 6)) if r.random() < 0.5 else "") for j, x in enumerate(own))
        around = [r.choice(junk).format(words(500 + j, 6)) for j in range(4)]
        wrap = r.choice(["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div class="layout has-sidebar"><article>{}</article></div>'])
        page = f"<html><head><title>t</title></head><body><header>site</header>{around[0]}{around[1]}{wrap.format(body)}{around[2]}{around[3]}<footer>foot</footer></body></html>"
        assert html_main.main_text(page) == "\n\n".join(own), page


def test_html_keeps_wrappers():
    text = "<p>First para, with commas, and more.</p><p>Second, longer para, as it goes.</p>"
    want = "First para, with commas, and more.\n\nSecond, longer para, as it goes."
    side = '<div class="sidebar"><p>side, side</p></div>'
    for name in ("layout has-sidebar", "content with-sidebar", "no-sidebar", "post-body ad-free", "page_no-ads", "widget", "share-box"):
        assert html_main.main_text(f'<body><div class="{name}">{text}{side}</div></body>') == want, name
        assert html_main.main_text(f'<body><div id="{name}"><div><article>{text}</article></div>{side}</div><p>{"x, " * 40}</p></body>').startswith(want), name  # the article holds fewer points
    many = "<p>" + "Nice, really, very, much, so</p><p>" * 6 + "Yes, yes</p>"
    for name in ("comments", "sidebar with-icons", "ad no-border"):
        out = html_main.main_text(f'<body><div class="text">{text * 6}</div><div class="{name}"><p>Nice, really, very, much</p></div></body>')
        assert "Nice" not in out and out.startswith(want), name
    assert html_main.main_text(f'<body><div class="text">{text}</div><div id="comments">{many}</div></body>') == want
    assert html_main.main_text(f'<body><div class="text">{text}</div><div id="comments"><article class="comment">{many}</article></div></body>') == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_feistel(n):
    there = to.feistel(np.arange(n), n, 5)
    assert sorted(there) == list(range(n)) and list(to.feistel(there, n, 5, inverse=True)) == list(range(n))


@pytest.mark.parametrize("group", [to.GROUP, 5])
def test_training_order(spark, docs, rows, tmp_path, group, monkeypatch):
    monkeypatch.setattr(to, "GROUP", group)
    root = f"file://{tmp_path}/shards"
    got = to.materialise_training_order(spark, docs, root=root, length=16, per_shard=32).toPandas()
    encode = to.Tokens(to.VOCABULARY).encode
    assert sorted(got.slot) == list(range(len(got))) and got[got.place == 0].shape[0] == len(rows)
    read = to.read_slots(root, 16, 32, 0, len(got))
    for i, text, *_ in rows:
        ids = encode(text or "")
        for copy in [got[got.doc_id == i].sort_values(["sequence"])]:
            copies = sum(r[0] == i for r in rows)
            for k in range(copies):
                part = copy.iloc[k * len(copy) // copies:(k + 1) * len(copy) // copies]
                flat = read[part.slot.to_numpy()].ravel()
                assert list(flat[:len(ids)]) == ids and set(flat[len(ids):]) == {to.END} and part.n_tokens.sum() == len(ids)
    assert (to.read_slots(root, 16, 32, 30, 5) == read[30:35]).all()
    assert all(zlib.crc32(read[s].tobytes()) == c for s, c in zip(got.slot, got.crc32))
    assert to.materialise_training_order(spark, docs.where("false")).count() == 0


def test_tokens_equal_plain_encoding():
    t = to.Tokens(to.VOCABULARY)
    for text in ("", " lead", "a b", "It's  two\n\nlines ", "été à 42 km.\nNext", words(3, 200), "tab\tand nbsp x"):
        assert list(t(text)) == t.encode(text)


@pytest.mark.parametrize("run", [mixture.RUN, 1])
def test_mixture(spark, docs, rows, run, monkeypatch):
    monkeypatch.setattr(mixture, "RUN", run)
    monkeypatch.setattr(mixture, "BUCKETS", 4)
    got = mixture.mix_sources(spark, docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), held=("source_size", "first"))
    assert (by["size"] == by.held).all() and ((by.taken - by.target).abs() <= 1).all() and (by.target <= 3 * by["size"]).all()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, mixture.mix_sources(spark, docs).toPandas()[key].values)) == sorted(map(tuple, got[key].values))
    assert mixture.mix_sources(spark, docs.where("false")).count() == 0


def test_water_filling():
    assert mixture.water_fill([100, 100, 100], [5, 2, 1], 300, 3) == pytest.approx([187.5, 75, 37.5])
    assert mixture.water_fill([10, 100, 190], [5, 2, 1], 300, 3) == pytest.approx([30, 180, 90])
    assert mixture.water_fill([0, 5], [1, 1], 5, 3) == [0, 5]


def test_pipeline(spark, docs, rows):
    """Each stage against what brute force makes of its input."""
    import corpus_pipeline as P
    items = [(1, " ".join(words(6, 60).split()[:40]))]
    sf = tempfile.mkdtemp(prefix="spark-bench-")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    data, kept = docs, {}
    for name, stage in P.STAGES:
        before = data.collect()
        out = stage(spark, data, sf)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        data = common.Scratch(spark, "p").write(out, "out")
        kept[name] = (before, data.collect())
    ids = lambda got: Counter(r.doc_id for r in got)
    before, after = kept["language_id"]
    assert ids(after) == Counter(r[0] for r in rows if re.search(r"[^\W\d_]", r[1] or "")) and all(r.lang for r in after)
    before, after = kept["ngram_jaccard_join"]
    root = linked({r.doc_id: shingles(r.text) for r in before})
    assert ids(after) == Counter(r.doc_id for r in before if root[r.doc_id] == r.doc_id) and len(after) < len(before)
    before, after = kept["benchmark_decontamination"]
    leaks = lambda t: any(" ".join(item.split()[k:k + 13]) in t for _, item in items for k in range(len(item.split()) - 12))
    assert ids(after) == Counter(r.doc_id for r in before if not leaks(r.text)) and len(after) < len(before)
    before, after = kept["source_mixture"]
    size, held, taken = Counter(), Counter(r.source for r in before), Counter()
    for r in before:
        size[r.source] += len(r.text.split())
    for r in after:
        taken[r.source] += len(r.text.split())
    order = sorted(held, key=lambda x: (x is None, x or ""))
    target = mixture.water_fill([size[x] for x in order], [(5, 2, 1)[k % 3] for k in range(len(order))], sum(size.values()), 3)
    largest = max(len(r.text.split()) for r in before)
    assert all(abs(taken[x] - t) <= largest for x, t in zip(order, target)) and max(ids(after).values()) <= 3 * max(ids(before).values())
    before, after = kept["shard_packing"]
    assert ids(after) == ids(before) and Counter((r.shard, r.slot) for r in after).most_common(1)[0][1] == 1


def test_pipeline_of_nothing(spark, docs):
    import corpus_pipeline as P
    data = docs.where("false")
    for _, stage in P.STAGES:
        data = stage(spark, data, DATA)
    assert data.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and data.count() == 0
    assert P.run(spark, DATA).columns == data.columns
