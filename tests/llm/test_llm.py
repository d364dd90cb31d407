"""Operators of the llm subpackage against brute force, and on odd input: nulls, empty and very long
texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import base64
import hashlib
import html as html_module
import json
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import bpe, hamming, html, jaccard, mixing, neighbours, packing, token_counts, tool_calls, toxicity, warc, words
from palimpsest.llm.common import Scratch, maybe_in, not_in
from palimpsest.llm.graph import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, score double, size string, class string, n int"
LONG = " ".join(f"w{i}" for i in range(30_000))


def docs_of(spark, rows):
    """Documents with columns that operators use as names of their own."""
    return spark.createDataFrame([(i, t, s, 1.0, "x", "y", 3) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", None), (3, LONG, "a"), (4, LONG, "b"), (5, "a b", "b"), (5, "a b", "b"), (None, "x y z", "a"), (7, " \n\t ", "c"), (8, "Idiot you " * 20, "c")]


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return find


# --- shared ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("one_task", [0, 1_000_000])
def test_components(spark, one_task):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(300, i) for i in range(301, 340)] + [(400 + i, 401 + i) for i in range(40)]
    d = spark.createDataFrame(edges, "a long, b long")
    find = union_find({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in connected_components(d, Scratch(spark, "t"), one_task).collect()}
    assert got == {x: find(x) for e in edges for x in e}
    assert connected_components(d.limit(0), Scratch(spark, "t"), one_task).count() == 0


def test_bitmap(spark):
    s = Scratch(spark, "t")
    d, wanted = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    got = {r.k for r in maybe_in(d, "k", wanted, s).collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 800
    assert {r.k for r in not_in(d, "k", wanted, s).collect()} == set(range(5000)) - set(range(0, 5000, 7))
    assert maybe_in(d, "k", wanted.limit(0), s).count() == 0 and not_in(d, "k", wanted.limit(0), s).count() == 5000


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x1c ", max_size=40)), max_size=6))
def test_shingle_sets(texts):
    assert [len(s) for s in words.shingle_sets(pa.array(texts, pa.string()))] == [len(shingles(t)) for t in texts]


def test_slices_keep_texts():
    texts = ["A b" * 2_000_000, "C d", None, "E" * 9_000_000, "F g h i J k"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    sets = [s for b in words.slices(batch) for s in words.shingle_sets(b.column("text"))]
    assert [s.tolist() for s in sets] == [s.tolist() for t in texts for s in words.shingle_sets(pa.array([t], pa.string()))]


# --- 1 and 6: embeddings ----------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, id string")


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(size=16) * [0.05, 0.2, 0.4][i % 3]).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16), (None, rows[0][1]), (5, rows[5][1])]
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(fine)
    x = np.array([fine[i] / np.linalg.norm(fine[i]) for i in ids])
    s = x @ x.T
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(s >= 0.9, 1)))]
    find = union_find(ids, links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    out = neighbours.near_duplicates(spark, vectors(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.vec_id is None:
            assert r.component_id is None and r.kept is None
        elif r.vec_id in fine:
            assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], find(r.vec_id), find(r.vec_id) == r.vec_id)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert neighbours.near_duplicates(spark, vectors(spark, []).limit(0)).count() == 0


def test_groups_larger_than_a_list_join(spark):
    rng = np.random.default_rng(11)
    ones = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    centres = [ones[0], 0.955 * ones[0] + math.sqrt(1 - 0.955**2) * ones[1]]
    noise = rng.normal(size=(2, 150, 62)) @ ones[2:]
    noise *= math.sqrt(1 / 0.965 - 1) / np.linalg.norm(noise, axis=2, keepdims=True)
    tight = np.concatenate([centres[g] + noise[g] for g in (0, 1)])
    x = np.concatenate([tight, rng.normal(size=(1500, 64))])
    x = x.astype(np.float32).astype(float)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    inner = (s[:150, :150].sum() - 150) / (150 * 149)
    assert inner > 0.955 and 0.9 < s[:150, 150:300].max() < 0.95
    out = {r.vec_id: r for r in neighbours.near_duplicates(spark, vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    for i in range(300):
        assert (out[i].component_id, out[i].n_links) == (0, int((s[i] >= 0.9).sum()) - 1)


def test_all_pairs_where_the_audit_fails(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TURNS", 1)
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    monkeypatch.setattr(neighbours, "audit", lambda true, parts: 0.5)
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 8)), 4, axis=0) + rng.normal(size=(160, 8)) * 0.25
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))] + [(500, [1.0, 2.0])]
    y = np.array([v / np.linalg.norm(v) for v in (np.array(r[1]) for r in rows[:160])])
    s = y @ y.T
    find = union_find(range(160), [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s >= 0.9, 1)), strict=True)])
    out = {r.vec_id: r for r in neighbours.near_duplicates(spark, vectors(spark, rows)).collect()}
    for i in range(160):
        assert (out[i].component_id, out[i].n_links) == (find(i), int((s[i] >= 0.9).sum()) - 1)
    assert (out[500].component_id, out[500].n_links, out[500].recall) == (500, 0, 0.5)


def test_rare_pairs_are_found(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(100, 64))
    y -= (y * x[:100]).sum(axis=1, keepdims=True) * x[:100]
    y = 0.92 * x[:100] + math.sqrt(1 - 0.92**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    out = {r.vec_id: r for r in neighbours.near_duplicates(spark, vectors(spark, rows)).collect()}
    assert sum(out[8000 + i].component_id == i for i in range(100)) >= 97
    assert all(out[i].recall >= 0.98 for i in out)


def test_forest():
    rng = np.random.default_rng(12)
    for share in (0.0, 0.02, 0.1, 1.0):
        hit = np.triu(rng.random((40, 40)) < share, 1)
        hit |= hit.T
        tree = neighbours.forest(hit)
        pairs = lambda m: list(zip(*np.nonzero(np.triu(m, 1)), strict=True))
        one, other = union_find(range(40), pairs(hit)), union_find(range(40), pairs(tree))
        assert [one(i) for i in range(40)] == [other(i) for i in range(40)]
        assert tree.sum() == 40 - len({one(i) for i in range(40)}) and not (tree & ~hit).any()


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)] + [(1000 + i, [1.0] * 16) for i in range(10)] + [(2000, None), (2050, [0.0] * 16), (None, [1.0] * 16), (3, None)]
    out = hamming.nearest(spark, vectors(spark, rows), "vec_id % 50 = 0").collect()
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and any(v)}
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        by[r.query_id].append(r)
    assert set(by) == {i for i in fine if i % 50 == 0}
    hit = 0
    for q, found in by.items():
        true = sorted((-(fine[q] @ v) / np.linalg.norm(fine[q]) / np.linalg.norm(v), i) for i, v in fine.items() if i != q)[:5]
        hit += len({i for _, i in true} & {r.vec_id for r in found})
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
    assert hit / (5 * len(by)) >= 0.9
    assert [r.vec_id for r in by[1000]] == [1001, 1002, 1003, 1004, 1005]
    assert [(r.query_id, r.vec_id) for r in hamming.nearest(spark, vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]), "vec_id = 0").collect()] == [(0, 1)]
    assert hamming.nearest(spark, vectors(spark, []).limit(0), "true").count() == 0
    twice = [(0, [1.0, 0.0, 0.0]), (0, [0.0, 1.0, 0.0]), (1, [0.1, 0.9, 0.1]), (2, [0.9, 0.2, 0.1]), (2, [0.0, 0.0, 1.0])]
    best = {r.vec_id: r.score for r in hamming.nearest(spark, vectors(spark, twice), "vec_id = 0").collect()}
    assert best[1] == pytest.approx(0.9 / math.sqrt(0.83)) and best[2] == pytest.approx(0.9 / math.sqrt(0.86)), "the best of the vectors of a repeated vec_id, as query and as answer"


def test_pigeonhole():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (400, 8), dtype=np.uint8)
    index = hamming.MultiIndex(codes)
    for radius in (0, 5, 20, 31, 64):
        far = np.bitwise_count(codes ^ codes[7]).sum(axis=1)
        assert index.within(codes[7], radius).tolist() == np.flatnonzero(far <= radius).tolist()


# --- 2: toxicity ------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(800):
        w = list(rng.choice(vocabulary, 60))
        if i % 5 == 0:
            w[int(rng.integers(60))] = str(rng.choice(["Nasty!", "vileness", "vilest."]))
        rows.append((i, ". ".join(" ".join(w[k : k + 10]) for k in range(0, 60, 10)), "a"))
        labels.append((i, int(i % 5 == 0), 1, "t"))
    labels = spark.createDataFrame(labels + [(1, None, 1, "t"), (None, 1, 1, "t")], "doc_id long, toxic int, score int, text string")
    d = docs_of(spark, rows + [(900 + i, t, s) for i, t, s in ODD if i])
    model = toxicity.train(d, labels)
    out = {r.doc_id: r for r in toxicity.score(spark, d, model).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(800))
    assert sum(out[i].predicted == int(i % 5 == 0) for i in held) / len(held) > 0.97
    assert out[901].score == out[902].score == pytest.approx(toxicity.LEAK) and all(0 <= r.score <= 1 for r in out.values())
    spots = toxicity.locate(spark, d, model).collect()
    assert spots and all(re.search("nasty|vile", r.sentence) for r in spots if r.doc_id < 800)
    kept = toxicity.drop_toxic(spark, d, labels)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.predicted}
    clean = [t for i, t, _ in rows if i % 5]
    long = docs_of(spark, [(k, ". ".join((clean * 2)[:k]), "a") for k in (50, 400, 1200)] + [(7, ". ".join(clean) + ". so nasty.", "a")])
    found = {r.doc_id: r.score for r in toxicity.score(spark, long, model).collect()}
    assert found.pop(7) >= 0.3 and max(found.values()) < 0.3  # clean sentences add up to nothing
    idf = lambda w: sum(model.weights[i] for i in toxicity.features_of(pa.array([w]))[0])
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for i, t, _ in rows[:40]:
        p = [max(0.0, 1 - (1 - sigmoid(sum(map(idf, x.lower().split())) + model.bias)) / (1 - sigmoid(model.bias))) for x in re.split(r"(?<=[.!?])\s+", t)]
        assert abs(out[i].score - max(1 - (1 - toxicity.LEAK) * math.prod(1 - x for x in p[k : k + toxicity.SPAN]) for k in range(len(p)))) < 1e-9 and abs(out[i].worst_score - max(p)) < 1e-9
        assert p[out[i].worst_sentence] >= max(p) - 1e-12
    assert toxicity.score(spark, d, toxicity.train(d.limit(0), labels.limit(0))).agg(F.max("score")).first()[0] < 0.3


def test_what_is_fitted_is_what_is_scored():
    """The gradient of the loss by differences of ``Model.score``: fitted weights are where it is nearly level, both ways."""
    rng = np.random.default_rng(8)
    texts, labels = [], []
    for i in range(200):
        w = [str(x) for x in rng.choice([f"plain{k}" for k in range(40)], 90)]
        if i % 4 == 0:
            w[int(rng.integers(90))] = "awful"
        if i % 8 == 1:
            w[int(rng.integers(90))] = "rude"  # in clean documents too
        if i % 16 == 0:
            w[int(rng.integers(90))] = "rude"
        texts.append(". ".join(" ".join(w[k : k + 5]) for k in range(0, 90, 5)))
        labels.append(int(i % 4 == 0))
    docs, y = pa.array(texts), np.array(labels)
    doc, sentence, codes, table = toxicity.sentences(docs)
    used = np.unique(toxicity.features_of(pa.array(["awful", "rude"])))
    cut, bags = np.searchsorted(doc, np.arange(len(texts) + 1)), []
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        at, which = np.nonzero(np.isin(table[codes[a:z]], used))
        bags.append((int(sentence[z - 1] - sentence[a]) + 1, sentence[a:z][at] - sentence[a], table[codes[a:z]][at, which]))
    model = toxicity.fit(bags, y, np.ones(len(y)), used)

    def loss(weights, bias):
        p = np.clip(toxicity.Model(weights, bias).score(docs)[0], 1e-9, 1 - 1e-9)
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    fitted, scores = loss(model.weights, model.bias), model.score(docs)[0]
    for f in used[model.weights[used] != 0]:
        for by in (-1.0, 1.0):
            moved = model.weights.copy()
            moved[f] += by
            assert loss(moved, model.bias) > fitted - 2e-3
    assert scores[y == 1].min() > 0.5 > 0.3 > scores[y == 0].max()


# --- 3: html ----------------------------------------------------------------------------------------


def test_extract(spark):
    page = "<html><head><title>t</title><style>p{{}}</style></head><body><nav><a>Home</a></nav>{}<footer>&copy; x</footer></body></html>"
    rows = [
        (1, "http://h/1", page.format("<article><h1>T &amp; u</h1><p>one <b>tw</b>o<br>three&nbsp;x<p>four<script>'</p>'</script><div class='comments'>c</div></article>")),
        (2, "http://h/2", None),
        (3, None, ""),
        (4, "http://g/4", page.format("<p>alpha beta gamma</p><p>we use cookies on this site please agree</p>")),
        (5, "http://g/5", page.format("<p>delta epsilon</p><p>we use cookies on this site please agree</p>")),
        (5, "http://g/5", page.format("<p>delta epsilon</p><p>we use cookies on this site please agree</p>")),
        (8, "http://g/8", page.format("<p>zeta</p><p>we use cookies on this site please agree</p>")),
        (6, "http://g/6", "<p>" + "long word " * 50_000),
        (7, "http://g/7", page.format("<header>site</header><main><p>x < y</p><aside>ad</aside></main>")),
    ]
    d = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(d).collect())
    texts = {1: "T & u\none two three x\nfour", 2: "", 3: "", 4: "alpha beta gamma", 5: "delta epsilon", 8: "zeta", 6: ("long word " * 50_000).strip(), 7: "x < y"}
    assert got == sorted((r[0], texts[r[0]], len(texts[r[0]])) for r in rows)
    assert html.extract(d.limit(0)).count() == 0


def test_classes_do_not_empty_articles():
    texts = lambda h: [t for k, t in html.blocks(h) if k == html.ARTICLE]
    assert texts("<article class='post comments-open'><p>one</p><div class='search-results'>two</div><label>three</label> <svg><title>x</title><text>four</text></svg></article>") == ["one", "two", "three four"]
    assert texts("<main id='search-form'>a<div class='post comments'>c</div><div class='ad'>d</div></main>") == ["a"]


def test_large_host_and_near_copies(spark):
    """Boilerplate on few pages of a large host goes; what near copies share, and words inside of blocks, stay."""
    words_of = lambda *seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, 12))
    rows, want = [], {}
    for i in range(1000):
        text = f"Unique opening words of page number {i}. The committee met again in the autumn to talk it over"
        rows.append((i, f"http://Big/{i}", f"<div>Home</div><p>{text}</p>" + "<p>A rare note on few pages, please read it with care.</p>" * (i % 200 == 7)))
        want[i] = text
    for i in range(2000, 2004):  # near copies: one paragraph differs
        rows.append((i, f"http://copies{i // 2}/{i}", f"<p>{words_of(1)}</p><p>{words_of(2, i)}</p>"))
        want[i] = f"{words_of(1)}\n{words_of(2, i)}"
    rows += [(i, f"http://same/{i}", f"<p>{words_of(3)}</p>") for i in range(3000, 3009)]
    want |= {i: words_of(3) for i in range(3000, 3009)}
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    assert {r.page_id: r.text for r in html.extract(d).collect()} == want


def test_articles_inside_chrome():
    texts = lambda h: [t for k, t in html.blocks(h) if k == html.ARTICLE]
    assert texts("<article><p>Main</p></article><aside><article><p>Related teaser text</p></article></aside>") == ["Main"]
    assert texts("<nav><ul><li>a<article><p>main</p></article>") == ["main"] and texts("<aside><article>only</article></aside>") == ["only"]
    assert texts("<nav>x<article>m</article><footer><article>t</article></footer>") == ["m"] and texts("<div class='has-sidebar'><article>m</article></div>") == ["m"]
    for name in ("class='sidebar-widget'", "class='cookie-banner'", "id='related-posts'", "class='comments-area'", "class='newsletter-signup'"):
        assert texts(f"<main><p>one</p><div {name}>no</div></main>") == texts(f"<article><p>one</p><div {name}>no</div></article>") == ["one"], name
    assert texts("<main><div class='share-prices'>a</div><div class='article-body'>b</div></main>") == ["a", "b"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=6))
def test_longest_repeats(streams):
    """The suffix array against a search for every length at every place."""
    rows = [(p, i, np.array(s[i:], np.uint64)) for p, s in enumerate(streams) for i in range(len(s))]
    has = lambda p, x: any(streams[p][i : i + len(x)] == x for i in range(len(streams[p])))
    want = []
    for p, i, _ in rows:
        n = [k for k in range(1, len(streams[p]) - i + 1) if sum(has(q, streams[p][i : i + k]) for q in range(len(streams))) >= html.PAGES]
        want.append(max(n, default=0))
    assert html.longest_repeats([r[2] for r in rows], [(r[0],) for r in rows]) == want


def test_grams():
    s = np.random.default_rng(7).integers(0, 6, 40).astype(np.uint64)
    assert all(html.grams(s, 4)[i] == html.grams(s[i : i + 4], 4)[0] for i in range(37)) and len(html.grams(s[:3], 4)) == 0


def test_unique_blocks():
    texts = ["a b c", "d e f g h i", "j"]  # in the stream at 1, 5 and 12
    assert html.unique_blocks(texts, [True] * 3, [(4, 8)]) == ["a b c", "j"]
    assert html.unique_blocks(texts, [True] * 3, [(6, 5)]) == texts  # a part of a block is no block
    assert html.unique_blocks(texts, [True] * 3, [(4, 5), (7, 6)]) == ["a b c", "d e f g h i"]  # and neither are two parts
    assert html.unique_blocks(texts, [True, False, True], [(0, 12)]) == ["j"]
    assert html.unique_blocks(["a b"], [True], [(0, 4)]) == ["a b"]
    long = " ".join("abcdefghij" * 10)
    assert html.unique_blocks([long, "z"], [True] * 2, [(p, min(html.DEPTH, 102 - p)) for p in range(95)]) == ["z"]
    assert html.unique_blocks([long, "z"], [True] * 2, [(p, min(html.DEPTH, 102 - p)) for p in range(95) if p != 30]) == [long, "z"]


def test_only_one_repeat_makes_boilerplate(spark):
    """Every eight tokens of a page's paragraph are on three other pages, the whole of it on none: counts of eight tokens
    would remove it, the longest repeats of the suffix array do not. The notice is one repeat."""
    words_of = lambda *seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, 12)).split()
    left, right = words_of(1), words_of(2)
    stitched = " ".join(left + right)
    notice = "all rights are reserved by the owners of this site and its friends"
    pages = [(0, f"<p>{stitched}</p><p>{notice}</p>")]
    for k in range(3):
        pages.append((1 + k, f"<p>{' '.join(words_of(3, k) + left + right[:7] + words_of(4, k))}</p><p>{notice}</p>"))
        pages.append((4 + k, f"<p>{' '.join(words_of(5, k) + left[5:] + right + words_of(6, k))}</p><p>{notice}</p>"))
    d = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in pages], "page_id long, url string, html string").repartition(3)
    out = {r.page_id: r.text for r in html.extract(d).collect()}
    assert out[0] == stitched and not any(notice in t for t in out.values()) and len(out) == 7
    s = html.stream_of([stitched])
    on = lambda x: sum(x in html.grams(html.stream_of([re.findall("<p>(.*?)</p>", h)[0]])).tolist() for _, h in pages[1:])
    assert all(on(g) >= html.PAGES for g in html.grams(s).tolist()[1:-1]), "but for its edges, it is made of common tokens"


def test_elements_in_doubt_are_decided_by_the_host(spark):
    """On pages that mark their article the suffix array decides elements whose names leave in doubt whether they are
    chrome. Pages of one chrome and different articles are different pages."""
    page = "<nav>Home</nav><article><p>Opening {0}</p><div class='{1}'><p>{2}</p></div><p>the same closing words on every single page of this whole site</p></article>"
    offer, prices = "get all of our best stories every week in your mail", "the prices of shares rose by {} in the first days of the year"
    pages = [(i, f"http://h/{i}", page.format(i, "post-newsletter-cta", offer)) for i in range(4)]
    pages += [(10 + i, f"http://h/{i}", page.format(10 + i, "share-prices", prices.format(i))) for i in range(4)]
    pages += [(20 + i, f"http://two/{i}", page.format(20 + i, "post-newsletter-cta", offer)) for i in range(2)]
    pages += [(30 + i, f"http://wrapped/{i}", page.format(30 + i, "has-social-sharing", f"{offer}</p><p>own words of page {i}")) for i in range(4)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    out = {r.page_id: r.text.split("\n")[1:-1] for r in html.extract(d).collect()}
    assert out == {i: [] if i < 10 else [prices.format(i - 10)] if i < 20 else [offer] if i < 30 else [offer, f"own words of page {i - 30}"] for i, _, _ in pages}


def test_long_repeats_are_one(spark):
    """Of two paragraphs longer than what suffixes are compared by at once, every part of that length is on three other
    pages of one host. Only the one that is whole on them goes."""
    words_of = lambda n, *seed: [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n)]
    n = html.DEPTH
    stitched, notice = words_of(2 * n, 1), " ".join(words_of(2 * n, 2))
    pages = [(0, f"<p>{' '.join(stitched)}</p><p>{notice}</p>")]
    for k in range(3):
        pages.append((1 + k, f"<p>{' '.join(words_of(9, 3, k) + stitched[: n + n // 2] + words_of(9, 4, k))}</p><p>{notice}</p>"))
        pages.append((4 + k, f"<p>{' '.join(words_of(9, 5, k) + stitched[n // 2 - 1 :] + words_of(9, 6, k))}</p><p>{notice}</p>"))
    d = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in pages], "page_id long, url string, html string").repartition(3)
    out = {r.page_id: r.text for r in html.extract(d).collect()}
    assert out[0] == " ".join(stitched) and not any(notice in t for t in out.values()) and len(out) == 7


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "é c", "a a b"]), max_size=4), max_size=5))
def test_streams_of_many_pages(pages):
    stream, n = html.streams_of(pa.array(pages, pa.list_(pa.string())))
    assert [x.tolist() for x in np.split(stream, np.cumsum(n)[:-1])][: len(pages)] == [html.stream_of(p).tolist() for p in pages]
    windows = [(p, k) for p in range(len(stream)) for k in range(1, len(stream) - p + 1)]
    named = {}
    for k in range(len(stream)):
        for p, h in enumerate(html.window_hashes(stream, np.minimum(k + 1, len(stream) - np.arange(len(stream)))).tolist()):
            named[p, min(k + 1, len(stream) - p)] = h
    assert len(set(named.values())) == len({tuple(stream[p : p + k].tolist()) for p, k in windows}) and set(named) == set(windows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=20))
def test_names(tokens):
    """Windows have one name if they have the same tokens, and only then."""
    s = np.array(tokens, np.uint64)
    windows = [(p, n) for p in range(len(s)) for n in range(1, len(s) - p + 1)]
    named = list(zip(html.names(s, windows), (tuple(tokens[p : p + n]) for p, n in windows), strict=True))
    assert len({a for a, _ in named}) == len({b for _, b in named}) == len(set(named))


# --- 4: warc ----------------------------------------------------------------------------------------


def test_archives(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c\r\nX: y%0A", ""), (5, "u", "é" * 100_000), (6, "u", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb"), (7, "w", "seven"), (7, "w", "seven"), (8, "v", "same"), (8, "v", "another"), (None, "n", "nn")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    out = warc.archive_pages(spark, d).collect()
    assert len(out) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, u, h in rows:
        b = (h or "").encode()
        stands = i is None or last[h or ""] == i
        want.append((i, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if stands else "revisit", None if stands else last[h or ""]))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out)
    assert all(r.record_type == "response" for r in warc.archive_pages(spark, d.filter("html = 'same'"), min_bytes=5).collect())
    assert warc.archive_pages(spark, d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3])
def test_partitions_without_pages(spark, n):
    """Their monolithic files hold no record, whatever files the task reads besides."""
    d = spark.range(0, n, 1, 8).selectExpr("id AS page_id", "'u' AS url", "concat('p', id) AS html")
    assert sorted(r.page_id for r in warc.archive_pages(spark, d).collect()) == list(range(n))


def test_normalise_round_trip(spark, tmp_path):
    records = [warc.record(i, "u", b"p" * i) for i in range(50)]
    z = zlib.compressobj(6, wbits=31)
    (tmp_path / "a.warc.gz").write_bytes(z.compress(b"".join(records)) + z.flush())
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "file string")
    index = warc.normalise(files, f"file://{tmp_path}/out").collect()
    data = (tmp_path / "out/a.warc.gz").read_bytes()
    assert [zlib.decompress(data[r.offset : r.offset + r.length], wbits=31) for r in index] == records
    assert zlib.decompressobj(wbits=31).decompress(data) == records[0]
    sidecar = [line.split("\t") for line in (tmp_path / "out/a.warc.gz.idx").read_text().splitlines()]
    assert [(i, int(o), int(n)) for i, o, n in sidecar] == [(r.record_id, r.offset, r.length) for r in index]


# --- 5: tool calls ----------------------------------------------------------------------------------


def test_link(spark):
    tools = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["string", "null"], "maxLength": 3}}, "additionalProperties": False}}
    calls = [
        (1, 0, "x", "add", '{"b": null, "a": 1}', []),
        (1, 1, "y", "add", '{"a": -1, "c": 2}', ["x"]),
        (1, 2, "z", "add", "no json", ["y", "gone"]),
        (1, 3, "p", "add", '{"a": 1.0}', ["q"]),
        (1, 4, "q", None, None, ["p"]),
        (1, 5, None, "add", '{"a": true}', None),
        (2, 0, "x", "mul", "{}", None),
        (1, 0, "x", "add", '{"b": null, "a": 1}', []),
    ]
    results = [(1, 9, "x", "late"), (1, 8, "x", "ré\n"), (1, 1, "orphan", "o"), (None, 1, "x", "n"), (2, 3, "x", None)]
    c = spark.createDataFrame([(*r, "z", 1) for r in calls], "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, level string, n int")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    out = sorted(tool_calls.link(spark, c, r, tools).collect(), key=lambda x: (x.conv_id, x.position))
    assert [(x.conv_id, x.call_id, x.level, x.position, x.status, x.valid) for x in out] == [
        (1, "x", 0, 0, "linked", True), (1, "x", 0, 1, "linked", True), (1, None, 0, 2, "open", False), (1, "y", 1, 3, "open", False), (1, "z", 2, 4, "open", False), (1, "p", None, 5, "open", True), (1, "q", None, 6, "open", False), (2, "x", 0, 0, "linked", False),
    ]
    assert out[0].json == '{"arguments":{"a":1,"b":null},"call_id":"x","conv_id":1,"name":"add","result":{"content":"ré\\n"}}'
    assert out[3].errors == "$.a: range; $.c: unknown" and json.loads(out[7].json)["result"] == {"content": None}
    assert tool_calls.link(spark, c.limit(0), r.limit(0), tools).count() == 0


# --- 7: n-gram Jaccard join --------------------------------------------------------------------------


def jaccard_truth(rows):
    sets = {k: shingles(t) for k, (i, t, _) in enumerate(rows) if i is not None}
    ids = {k: rows[k][0] for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    order = sorted(sets, key=lambda k: ids[k])
    place = {k: n for n, k in enumerate(order)}
    find = union_find(range(len(order)), [(place[a], place[b]) for a, b in links])
    return sorted((ids[k], len(sets[k]), ids[order[find(place[k])]]) for k in sets)


def test_jaccard(spark):
    rng = np.random.default_rng(8)
    w = [f"w{i}" for i in range(40)]
    rows = list(ODD)
    for g in range(25):
        base = list(rng.choice(w, int(rng.integers(4, 120))))
        for c in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = "changed" + str(rng.integers(99))
            rows.append((100 + 10 * g + c, " ".join(copy), "s"))
    passage = " ".join(rng.choice(w, 60))
    rows += [(1000 + i, passage + " " + " ".join(f"u{i}_{k}" for k in range(i)), "s") for i in range(40)]
    out = jaccard.jaccard_components(spark, docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None) == jaccard_truth(rows)
    assert [(r.n_shingles, r.component_id) for r in out if r.doc_id is None] == [(1, None)]
    kept = jaccard.keep_one(spark, docs_of(spark, rows))
    gone = {i for i, _, c in jaccard_truth(rows) if i != c}
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({i for i, _, _ in rows if i is not None and i not in gone})
    assert jaccard.jaccard_components(spark, docs_of(spark, rows).limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    t, u = "one two three four five six", "seven eight nine"
    rows = [(1, t, "a"), (1, t, "a"), (None, t, "a"), (2, t, "b"), (1, u, "a"), (4, u, "a"), (None, "", "a"), (None, "", "a"), (5, None, None), (6, "", None), (None, "alone here", "c"), (None, "alone here", "c")]
    kept = jaccard.keep_one(spark, docs_of(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(2, t), (4, u), (None, ""), (5, None), (6, ""), (None, "alone here")]))
    same = [(1, t, "a"), (1, t, "a"), (1, u, "a")]
    assert sorted(map(tuple, jaccard.keep_one(spark, docs_of(spark, same)).select("doc_id", "text").collect())) == [(1, t), (1, u)]
    assert jaccard.keep_one(spark, docs_of(spark, rows).limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.integers(1, 3))
def test_prefixes_meet(a, b, order):
    if 100 * len(a & b) >= 80 * len(a | b):
        cells = np.random.default_rng(1).integers(0, 9, 1 << 10).astype(np.uint8)
        x, y = (words.mix(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert set(jaccard.prefix(x, cells, order).tolist()) & set(jaccard.prefix(y, cells, order).tolist())


def test_needed():
    for percent in (50, 80, 90):
        for n in range(1, 81):
            least = min(
                min(jaccard.first_tokens(n) - x, jaccard.first_tokens(n - x + y) - y)
                for x in range(n)
                for y in range(2 * n)
                if jaccard.linked(n - x, n, n - x + y, percent)
            )
            assert jaccard.needed(n, percent) == least


def test_short_texts_link(spark):
    rng = np.random.default_rng(9)
    rows = []
    for short, long in ((8, 9), (12, 14), (13, 15)):
        for _ in range(60):
            words = [f"w{x}" for x in rng.integers(0, 1 << 40, long)]
            rows += [(len(rows), " ".join(words[:short]), "a"), (len(rows) + 1, " ".join(words), "a")]
    out = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark, docs_of(spark, rows)).collect()}
    assert out == {i: i // 2 * 2 for i in range(len(rows))}


# --- 8: mixing --------------------------------------------------------------------------------------


def test_targets():
    t = mixing.targets([("b", 100), ("a", 10), (None, 200), ("c", 0)])
    assert t["a"] == 30 and t["c"] == 0 and t[None] == pytest.approx(280 / 3) and t["b"] == pytest.approx(560 / 3)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0}


def test_mix(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400))), ["a", "b", "c", None][int(rng.integers(4))]) for i in range(400)] + ODD
    d = docs_of(spark, rows)
    out = mixing.mix(spark, d).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(spark, d).collect())) and len(out) == len(rows)
    size, took, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        size[r.source] += r["size"]
        took[r.source] += r.taken
        target[r.source] = r.target
    assert target == pytest.approx(mixing.targets(list(size.items())))
    assert all(abs(took[s] - target[s]) <= 60_000 / 2 for s in size)
    repeated = mixing.repeat_documents(spark, d)
    assert repeated.columns == d.columns and repeated.count() == sum(r.n_copies for r in out)
    assert mixing.mix(spark, d.limit(0)).count() == 0


def test_mix_meets_targets_closely_and_without_broadcasts(spark, monkeypatch):
    """Without very long texts the words taken are within one small document of each target, the multipliers are
    those of the closed form, and tables too large to be broadcast change nothing."""
    rng = np.random.default_rng(10)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), ["a", "b", "c", None][int(rng.integers(4))]) for i in range(1500)]
    d = docs_of(spark, rows)
    out = mixing.mix(spark, d).collect()
    size, took, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        size[r.source] += r["size"]
        took[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(took[s] - target[s]) <= 10 for s in size)
    lam = mixing.dual(mixing.sized(d), target, size)
    assert lam == pytest.approx({s: math.log(target[s] / size[s]) for s in size}, abs=1e-6)
    monkeypatch.setattr(mixing, "SENT", 0)
    assert sorted(map(repr, mixing.mix(spark, d).collect())) == sorted(map(repr, out))


# --- 9 and 10: tokens -------------------------------------------------------------------------------


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*" \n\ta'é1.日😀\x1c\u200bBs", "<|endoftext|>", "word", " " * bpe.RUN, "\u3000\n" * bpe.RUN]), max_size=30).map("".join))
def test_ids_are_those_of_tokenizers(text):
    test_ids_are_those_of_tokenizers.t = t = getattr(test_ids_are_those_of_tokenizers, "t", None) or tokenizer()
    assert bpe.encoder(bpe.default_vocabulary())(text).tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 10**6, "\n" * 10**6 + "a", "a" * 10**6, "x" + " " * 10**6 + "<|endoftext|>" + " " * 5000 + "y", "one two\n" * 200_000], ids=lambda t: repr(t[:9]))
def test_very_long_texts_encode(text):
    assert bpe.encoder(bpe.default_vocabulary())(text).tolist() == tokenizer().encode(text, add_special_tokens=False).ids


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "\n", " " * bpe.RUN, "\u3000"]), max_size=12).map("".join))
def test_spans_tile_a_text(text):
    found = list(bpe.spans(text))
    assert "".join(text[a:b] for a, b, _ in found) == text and all(text[a:b].isspace() for a, b, run in found if run)


def test_token_counts(spark):
    out = {r.n_tokens: r for r in token_counts.token_counts(docs_of(spark, ODD)).collect()}
    n = sorted(len(bpe.encoder(bpe.default_vocabulary())(t)) for _, t, _ in ODD)
    for length, r in out.items():
        assert (r.n_docs, r.docs_upto, r.docs_longer) == (n.count(length), sum(x <= length for x in n), sum(x > length for x in n))
        assert (r.tokens_upto, r.tokens_longer, r.truncated_total) == (sum(x for x in n if x <= length), sum(x for x in n if x > length), sum(min(x, length) for x in n))
    h = token_counts.length_histogram(token_counts.encoded_lengths(docs_of(spark, ODD)))
    assert token_counts.quantile(h, 0.5) == n[math.ceil(len(n) / 2) - 1] and token_counts.truncated_total(h, 7) == sum(min(x, 7) for x in n)
    assert token_counts.quantile(h.limit(0), 0.5) is None and token_counts.truncated_total(h.limit(0), 7) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1023), max_size=60))
def test_pack_group(sizes):
    seen = defaultdict(list)
    for s in packing.pack_group(sizes, 1024):
        assert 0 < sum(x for *_, x in s) <= 1024
        for i, start, length in s:
            seen[i].append((start, length))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_windows_are_near_equal_by_differencing(monkeypatch):
    """Full groups: little padding, few cuts; runs of rests in place of differencing need more windows."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1024, packing.GROUP).tolist()

    def measured():
        found = packing.pack_group(sizes, 1024)
        sums = [sum(n for *_, n in s) for s in found]
        assert sum(sums) == sum(sizes)
        return len(sums) * 1024 / sum(sizes) - 1, max(sums) - min(sums), sum(map(len, found)) - len(sizes)

    padding, spread, cuts = measured()
    assert padding < 0.02 and spread < 64 and cuts <= sum(n > 512 for n in sizes)
    monkeypatch.setattr(packing, "multiway_difference", lambda sizes, k: [list(map(int, x)) for x in np.array_split(np.arange(len(sizes)), k)])
    plain = measured()
    assert plain[0] > 3 * padding and plain[1] > 3 * spread


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=30))
def test_windows(sizes):
    parts = packing.windows_for(sizes, 100)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and all(sum(sizes[i] for i in p) <= 100 for p in parts)


def test_differencing():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.multiway_difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert sorted(sum([3, 3, 2, 2, 2][i] for i in p) for p in packing.multiway_difference([3, 3, 2, 2, 2], 3)) == [3, 4, 5]
    assert len(packing.windows_for([60, 60, 60], 100)) == 3  # two windows would do for the sum
    with pytest.raises(ValueError):
        packing.windows_for([101], 100)


def test_pack(spark):
    rows = packing.pack(docs_of(spark, ODD)).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    for i, t, _ in ODD:
        ids = np.append(bpe.encoder(bpe.default_vocabulary())(t), 0).astype("<u4")
        copies = sum(i == k for k, _, _ in ODD)
        assert sum(r.length for r in pieces[i]) == copies * len(ids)
        for r in pieces[i]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack(docs_of(spark, ODD).limit(0)).count() == 0


# --- the whole --------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p

    out = p.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for _, stage in p.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], SF))
        assert steps[-1].columns == docs.columns
    toxic, unique, mixed = steps[1:]
    rows = [(r.doc_id, r.text, r.source) for r in toxic.collect()]
    truth = jaccard_truth(rows)
    assert {r.doc_id for r in unique.collect()} == {i for i, _, c in truth if i == c}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    tokens = defaultdict(int)
    for r in out:
        tokens[r.doc_id] += r.length
    assert set(tokens) == set(counts)
    for r in unique.collect():
        if r.doc_id in counts:
            assert tokens[r.doc_id] == counts[r.doc_id] * (len(bpe.encoder(bpe.default_vocabulary())(r.text)) + 1)


def test_oracles(spark):
    import glob
    import os

    import duckdb

    from palimpsest.llm import queries

    con = duckdb.connect()
    for t in ("pages", "conversations", "documents", "labels"):
        at = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at if os.path.isfile(at) else glob.glob(at + '/*.parquet')[0]}'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(repr, cursor.fetchall()))


def test_entities_are_decoded():
    assert html.blocks("<p>&lt;b&gt; &#8364; &eacute; &bogus; &amp;amp;</p>") == [(html.OPEN, html_module.unescape("&lt;b&gt; &#8364; &eacute; &bogus; &amp;amp;"))]
