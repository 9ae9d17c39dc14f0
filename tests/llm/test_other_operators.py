"""Vectors, pages, licences, labels, benchmark passages and the pipeline."""

import collections
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from framesleuth.llm import catalog, components, decontaminate, embed_dedup, html_text, licenses, minhash, quality, toxicity
from oracle_check import compare, connect

FOLDER, LABELLED, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
CLASH = "label int, kept string, row_key string, component string, toxic string, key int, log_weight string, p_toxic int"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    want = connect(FOLDER).execute(catalog.oracle_sql()[name]).df()
    assert len(want) and compare(catalog.queries()[name](spark, FOLDER).toPandas(), want) is None


def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(catalog.queries(), key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(100, 400)] + [(7, 9), (9, 7), (9, 9), (5, 9)]
    random.seed(1)
    random.shuffle(edges)
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 100 for k in range(100, 401)}, 5: 5, 7: 5, 9: 5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(4)
    out = [(i, rng.normal(size=6).round(2).tolist(), int(i % 3)) for i in range(150)]
    out += [(1000 + i, (np.array(out[i % 20][1]) + rng.normal(size=6) * 0.12).tolist(), out[i % 20][2]) for i in range(120)]
    out += [(2000 + i, out[0][1], 0) for i in range(4)] + [(2010, [2 * x for x in out[0][1]], 0), (2011, [1e300 * x for x in out[0][1]], 0)]
    out += [(3000, None, 0), (3001, [0.0] * 6, 0), (3002, [1.0, None, 0, 0, 0, 0], 0), (3003, [float("nan")] * 6, 0), (3004, [float("inf"), 0, 0, 0, 0, 0], 0), (3005, out[0][1], None), (3006, [], 0), (3007, [3.0], 1), (3008, [5.0], 1), (3009, [-5.0], 1)]
    return [(i, None if v is None else [None if x is None else float(x) for x in v], c) for i, v, c in out]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", block)
    rows = vectors()
    good = {i: (np.array(v) / max(map(abs, v)), c) for i, v, c in rows if v and c is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98]
    assert len(links) > 100
    want = brute.least_members([i for i, *_ in rows], links)
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in pair for pair in links) for i in got}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_vectors_empty(spark):
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, kept int")).count() == 0


PAGES = {
    "menus": ("<html><head><title>T</title></head><body><nav><ul><li>Home</ul></nav><header>Site</header><div class='cookie-notice'>We use cookies</div><article><h1>A &amp;  B</h1><p>one\n two<p>three &eacute;&nbsp;x<br>four<script>var a='</p>';</script><ul><li>i<li>j</ul><div class='share-box'>Share</div><section id=comments><article>Nice!</article></section></article><aside>More</aside><form>Mail <input></form><footer>&copy;</footer></body></html>", "A & B\none two\nthree é x\nfour\ni\nj"),
    "cut": ("<body><article><h1>H</h1><p>text and &am", "H\ntext and &am"),
    "cut in a tag": ("<body><article><p>text <a hre", "text"),
    "null": (None, ""),
    "empty": ("", ""),
    "text": ("no <3 markup > here", "no <3 markup > here"),
    "wrapper": ("<div class='layout with-sidebar'><nav>n</nav><article><p>A</p></article><div class='sidebar'>s</div></div>", "A"),
    "wrapper of comments": ("<div class='post-comments-enabled'><article><p>A</p></article></div>", "A"),
    "form around the page": ("<body><form id='aspnetForm'><input type=hidden><article><p>A</p></article></form></body>", "A"),
    "names inside": ("<article><h2 id='related-work'>R</h2><p id='menu-of-the-day'>M</p><blockquote class='notice'>Q</blockquote><section class='related-work'>S</section><div class='ad'>x</div><div class='post-comments'>c</div></article>", "R\nM\nQ\nS"),
    "comments beside main": ("<main><p>M</p></main><div class='comments'><article>C</article></div>", "M"),
    "comments after": ("<article>A</article><section class='comments'><article>C</article></section>", "A"),
    "open quote": ("<article><p title=\"x>text</p><p>more</p></article>", "text\nmore"),
    "quoted end": ("<article><p title=\"a > b\">text</p></article>", "text"),
    "hidden": ("<main><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=true>no</p><table><tr><td>a<td>b</table></main>", "a\nb"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page_blocks(name):
    page, want = PAGES[name]
    blocks = html_text.page_blocks(page)
    assert "\n".join(t for inside, t in blocks if inside or not any(i for i, _ in blocks)) == want


@pytest.mark.parametrize("text", ["<a " + " ".join(f'x{k}="y"' for k in range(30)) + ' "', "<a " * 50_000, '<a b="' * 50_000, "<div>" * 50_000 + "</div>" * 50_000, "<p><b>" * 30_000, "<a \"'=" * 40_000, "<!--" * 50_000, "<script>" * 50_000, "<b>" * 100_000 + "<p>" * 1000, "<" * 200_000])
def test_broken_pages_cost_linear_time(text):
    start = time.time()
    html_text.page_blocks(text)
    assert time.time() - start < 10


def test_repeated_and_very_long_pages(spark):
    page = "<article>" + "<p>" + "word " * 200_000 + "</p>" + "<p>end</p></article>"
    got = html_text.main_text(spark.createDataFrame([(1, "https://h.example/a", page), (1, "https://h.example/a", page), (None, None, page)], "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == ["word " * 199_999 + "word\nend"] * 3


def test_shared_lines_are_a_longest_common_subsequence():
    random.seed(3)
    for _ in range(300):
        a, b = ([random.randrange(5) for _ in range(random.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        shared = html_text.shared_lines(a, b)
        rest = iter(b)
        assert sum(shared) == best[-1][-1] and all(x in rest for x, s in zip(a, shared) if s)


def test_pages_with_an_article_are_compared_too(spark):
    rows = [
        (1, "https://h.example/a/1", "<div>Top</div><article><p>One</p><p>Two</p><p>Own</p></article>"), (2, "https://h.example/a/2", "<article><p>One</p><p>Two</p><p>Other</p></article>"),
        # The print version of page 4 has no article; what is in the article there is text.
        (3, "https://p.example/x/print", "<div>Top</div><p>Story</p><p>goes on</p><div>Printed today</div>"), (4, "https://p.example/x/read", "<div>Top</div><article><p>Story</p><p>goes on</p></article>"), (5, "https://q.example/", "<article>Alone</article>"),
    ]
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("One\nTwo\nOwn", 2), 2: ("One\nTwo\nOther", 2), 3: ("Story\ngoes on\nPrinted today", 2), 4: ("Story\ngoes on", 2), 5: ("Alone", 0)}


def test_main_text_differences(spark):
    def page(k):
        return f"<body><div>Top line</div><p>Story {k} first</p><p>Story {k} second</p><div>Bottom line</div></body>"

    rows = [(k, f"https://h.example/news/{k}", page(k)) for k in range(6)] + [
        (10, "https://alone.example/x", page(10)), (11, None, page(11)), (12, "https://c.example/a", page(12)), (13, "https://c.example/a?x=1", page(12)),
        (14, "https://h.example/news/3", None), (15, "https://h.example/shop/1", "<article><p>Top line</p></article>"),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, blocks string")
    got = {r["page_id"]: r for r in html_text.main_text(frame).collect()}
    assert all(got[k]["text"] == f"Story {k} first\nStory {k} second" for k in (0, 1, 2, 5))
    whole = "Top line\nStory {0} first\nStory {0} second\nBottom line"
    assert [got[k]["text"] for k in (10, 11, 12, 13, 14, 15)] == [whole.format(10), whole.format(11), whole.format(12), whole.format(12), "", "Top line"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.main_text(frame.limit(0)).count() == 0


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("a/LICENSE.txt", mit), ("a/x.py", "code\nmore code"), ("a/b/y.py", "text\n" + gpl + "\nmore"), ("a/b/c/z.py", None), ("a/b/c/w.py", ""),
        ("top.py", "none"), ("d/COPYING", "This work is licensed under\nthe GNU General Public License,\nversion 3."), ("d/e/f/g.py", "x " * 20_000), (None, mit), ("d/both.py", gpl + "\n" + mit), ("d/both.py", gpl + "\n" + mit),
        ("a/shout.py", mit.upper()), ("a/other.py", "The licence of trees under the general sky"),
    ]
    frame = spark.createDataFrame([(*r, "old", 1) for r in rows], "path string, text string, license string, directory int")
    got = licenses.scan_licenses(frame).collect()
    assert len(got) == len(rows) and got[0]["directory"] == 1
    held = {r["path"]: (r["own_license"], r["license"], r["inherited_from"]) for r in got}
    assert held == {
        "a/LICENSE.txt": ("MIT", "MIT", None), "a/x.py": (None, "MIT", "a"), "a/b/y.py": ("GPL-3.0", "GPL-3.0", None), "a/b/c/z.py": (None, "MIT", "a"), "a/b/c/w.py": (None, "MIT", "a"),
        "top.py": (None, None, None), "d/COPYING": ("GPL-3.0", "GPL-3.0", None), "d/e/f/g.py": (None, "GPL-3.0", "d"), None: (None, None, None), "d/both.py": ("GPL-3.0", "GPL-3.0", None),
        "a/shout.py": ("MIT", "MIT", None), "a/other.py": (None, "MIT", "a"),
    }
    assert licenses.scan_licenses(frame.limit(0)).count() == 0


def test_notices_of_other_wordings_and_equal_paths(spark):
    rows = [
        ("a.py", "x\n# SPDX-License-Identifier: MIT\n"), ("b.c", "/* Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software"),
        ("c.py", "Released under the MIT License."), ("c.py", "five words are here now"), ("d", "GNU General Public License, version 2."), ("e/LICENSE", "The MIT License (MIT)\n\nCopyright 2020\n\nmore text of the licence file that says other things than this"),
        ("f", '# Licensed under the Apache License, Version 2.0 (the "License");'), ("g", "This program is free software: you can redistribute it and/or modify\nit under"), ("h", "nothing here"), ("i", "the " * 50_000 + " ".join(f"w{k}" for k in range(30_000))),
    ]
    got = {r["path"]: r["own_license"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a.py": "MIT", "b.c": "MIT", "c.py": "MIT", "d": "GPL-2.0", "e/LICENSE": "MIT", "f": "Apache-2.0", "g": "GPL-3.0", "h": None, "i": None}


def test_leaks_hostile(spark):
    item = "The quick brown fox jumps over the lazy dog and runs far away from here today"
    near = item.replace("away", "off")
    rows = [(1, "before " * 7 + item.upper() + "! after"), (2, near), (3, "The quick brown fox jumps over something else entirely different from before"), (4, None), (5, ""), (None, item), (7, "alpha beta"), (8, "say alpha, beta now"), (1, "x"), (9, "w " * 50_000 + item), (9, "w " * 50_000 + item)]
    docs = spark.createDataFrame([(i, t, 1, "k", "r", "c", "t", 0, "l", 1) for i, t in rows], "doc_id long, text string, " + CLASH)
    items = spark.createDataFrame([(1, item), (2, "Alpha beta"), (3, None), (None, "x"), (4, "...")], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["item_id"], r["n_windows"], r["similarity"] == 1) for r in decontaminate.find_leaks(docs, items).collect()))
    assert [g for g in got if g[0] != 2] == [(0, 1, 1, True), (1, 1, 3, True), (7, 2, 1, True), (8, 2, 1, True), (9, 1, 2, True)]
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"]) == [(1, "x"), *([(2, near)] if not any(g[0] == 2 for g in got) else []), (3, rows[2][1])]
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_moved_blocks_are_found(spark):
    """Windows count at every start, wherever in the item their shingles stand: against all windows."""
    one, two, other = (" ".join(f"{c}{k}" for k in range(30)) for c in "pqz")
    texts = [f"{other} {two} {one} {other}", f"{other} {one} {two} {other}", f"{two} {one}", other, f"{one} {other} {two} {one} {two}"]
    item = f"{one} {two}".split()

    def similarity(window):
        a, b = (collections.Counter(tuple(w[k : k + 5]) for k in range(max(0, len(w) - 4))) for w in (window, item))
        return (a & b).total() / max(1, (a | b).total())

    want = {}
    for i, text in enumerate(texts):
        w = text.split()
        found = [s for k in range(max(1, len(w) - len(item) + 1)) if (s := similarity(w[k : k + len(item)])) >= 0.8]
        if found:
            want[i] = (len(found), max(found))
    docs, items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["n_windows"], r["similarity"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert want[0][0] > 1 and want[1][0] > 10 and got == {i: (n, pytest.approx(s)) for i, (n, s) in want.items()}


def test_one_id_on_different_rows(spark):
    """Groups of different texts or vectors do not mix where they share an id, and none is lost."""
    a, b = ([f"{c}{k}" for k in range(40)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:-1])), (3, " ".join(b[:-1])), (1, " ".join(a)), (None, " ".join(a))]
    docs = spark.createDataFrame([(i, t, 1, "k", "r", "c", "t", 0, "l", 1) for i, t in rows], "doc_id long, text string, " + CLASH)
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    left = corpus_pipeline.drop_duplicates(spark, docs, "")
    assert left.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"][0]) for r in left.collect()) == [(0, "a"), (1, "a"), (1, "b")]

    x, y = [1.0, 0.0, 0.0, 0.2], [0.0, 1.0, 0.3, 0.0]
    vectors = [(1, x, 0), (1, y, 0), (2, [1.0, 0.05, 0.0, 0.2], 0), (3, [0.05, 1.0, 0.3, 0.0], 0)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_windows_within_the_radius_are_met():
    """Two fingerprints at most the radius apart share a block within its own radius."""
    random.seed(5)
    for _ in range(2000):
        flips = random.sample(range(64), decontaminate.RADIUS)
        per_block = [sum(f // decontaminate.BLOCK_BITS == b for f in flips) for b in range(decontaminate.BLOCKS)]
        assert min(per_block) <= decontaminate.BLOCK_RADIUS


def hostile(spark):
    rows = [(900_001, None), (900_002, ""), (900_003, "word " * 60_000), (None, "null id"), (900_004, "same text here"), (900_004, "same text here")]
    return spark.createDataFrame([(i, t, 1, "k", "r", "c", "t", 0, "l", 1) for i, t in rows], "doc_id long, text string, " + CLASH)


def split_labels(spark, folder, column):
    """Labels of even ids to learn from, and of odd ids to test on."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return labels.where("doc_id % 2 = 0"), {r["doc_id"]: r[column] for r in labels.where("doc_id % 2 = 1").collect()}


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    learn, test = split_labels(spark, LARGER, "quality")
    got = {r["doc_id"]: r["kept"] for r in quality.resample(docs, learn).collect()}
    assert len(got) == docs.count()
    assert sum(got[i] != (q == 1) for i, q in test.items()) <= 0.002 * len(test)


def test_quality_hostile(spark):
    docs, labels = hostile(spark), spark.read.parquet(f"{LABELLED}/labels.parquet")
    both = docs.unionByName(spark.read.parquet(f"{LABELLED}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    got = {r["doc_id"]: r for r in quality.resample(both, labels).where("doc_id IS NULL OR doc_id > 900000").collect()}
    assert got[900_001]["log_weight"] == got[900_002]["log_weight"] == 0 and got[900_001]["kept"] and got[900_002]["kept"] and got[None]["kept"] and got[900_004]["kept"]
    assert not got[900_003]["kept"]  # one word sixty thousand times
    assert sorted(quality.resample(both, labels).columns) == sorted({*docs.columns, "log_weight", "tempered_weight", "sample_key", "kept"})
    assert all(r["kept"] for r in quality.resample(docs, labels.limit(0)).collect())
    assert quality.resample(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("k", [1, 7, 500, 1000])
def test_kth_largest(spark, k):
    random.seed(k)
    values = [random.choice([random.gauss(0, 1), -1e5 * random.random(), 3.0]) for _ in range(1000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    assert quality.kth_largest(frame, "v", k, at_once=20) == sorted(values, reverse=True)[k - 1]


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    learn, test = split_labels(spark, LARGER, "toxic")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score_toxicity(docs, learn).collect()}
    assert sum(got[i] for i, t in test.items() if not t) <= 0.002 * len(test)  # clean documents
    assert sum(got[i] for i, t in test.items() if t) >= 0.8 * sum(test.values())


def test_toxicity_hostile(spark):
    docs, labels = hostile(spark), spark.read.parquet(f"{LABELLED}/labels.parquet")
    both = docs.unionByName(spark.read.parquet(f"{LABELLED}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    scored = toxicity.score_toxicity(both, labels)
    assert sorted(scored.columns) == sorted({*docs.columns, "p_insult", "p_contempt", "p_toxic", "toxic"})
    got = scored.where("doc_id IS NULL OR doc_id > 900000").collect()
    assert len(got) == 6 and not any(r["toxic"] for r in got) and len({r["p_toxic"] for r in got if r["doc_id"] in (900_001, 900_002)}) == 1
    assert not any(r["toxic"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_chain_passes_earlier_probabilities_on():
    rng = np.random.default_rng(1)
    first = rng.random(600) < 0.5
    columns = np.where(first, 0, 1)
    labels = np.column_stack([first, first])
    chain = toxicity.Chain(["a", "b"], np.arange(2, dtype="u8")).fit(np.arange(600), columns, labels, np.arange(600) % 5)
    assert len(chain.models[0]) == 3 and len(chain.models[1]) == 4 and chain.models[1][2] > 0.2


def test_pipeline_stages(spark, tmp_path):
    """Every stage against a plain version of what it should keep of its own input."""
    docs = spark.read.parquet(f"{LABELLED}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    duck = connect(LABELLED)
    leaked = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({decontaminate.ORACLE})").fetchall()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, LABELLED)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left = {r[0] for r in docs.select("doc_id").collect()}
        if name == "quality":
            assert all((i in left) == (labels[i]["quality"] == 1) for i in before if i in labels)
        elif name == "toxicity":
            assert all((i in left) == (labels[i]["toxic"] == 0) for i in before if i in labels and i in left or i in labels and labels[i]["toxic"] == 0)
        elif name == "near_duplicates":
            want, _ = brute.near_documents(list(before.items()), 80)
            assert left == {i for i, c in want.items() if i == c}
        elif name == "decontamination":
            assert left == set(before) - leaked
        if name != "packing":
            assert docs.columns == columns
        else:
            assert left == set(before) and docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_near_stage_takes_copies_from_80(spark):
    random.seed(8)
    rows = []
    for k in range(60):
        words = [f"w{k}x{j}" for j in range(104)]  # 100 shingles
        # Two copies with a few words changed or left out.
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join([*words[:40], *("y" * (j + 1) for j in range(random.randrange(2, 7))), *words[46:]])), (3 * k + 2, " ".join([*words[:60], f"z{k}", *words[61 + k % 13 :]]))]
    want, other = brute.near_documents(rows, 80)[0], brute.near_documents(rows)[0]
    assert sum(i == c for i, c in want.items()) < sum(i == c for i, c in other.items())
    got = corpus_pipeline.drop_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), LABELLED)
    assert {r["doc_id"] for r in got.collect()} == {i for i, c in want.items() if i == c}


def test_copies_of_a_notice_are_compared_once(spark, monkeypatch):
    rows_of, write = {}, licenses.scratch.write

    def counted(df, label, *rest):
        out = write(df, label, *rest)
        rows_of[label] = out[0].count()
        return out

    monkeypatch.setattr(licenses.scratch, "write", counted)
    seen = []
    for copies in (1, 40):
        frame = spark.createDataFrame([(f"d/{i}.py", "code()\nReleased under the MIT License.\n# All rights reserved.") for i in range(copies)], "path string, text string")
        got = [tuple(r) for r in licenses.find_notices(frame).select("unit", "license").collect()]
        assert sorted(got) == sorted([(1, "MIT"), (2, "LicenseRef-All-Rights-Reserved")] * copies)
        seen.append(rows_of["counts"])
    assert seen[0] == seen[1]
