"""Embeddings and pages against brute force, over the awkward cases; queries and the pipeline."""
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsift.llm import hnsw, html_main
from docsift.llm.components import components, roots
from docsift.llm.embed_dedup import embedding_duplicates, quantise
from docsift.llm.queries import ORACLES, QUERIES

from .fixtures_llm import docs_df, documents, row

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, tile string, score string"


def vectors(n=300, d=16, seed=5):
    """Clusters, copies, and every kind of vector that takes no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [(i, (centres[i % 12] + 0.16 * rng.normal(size=d)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(15)]  # copies
    rows += [(1100 + i, [2 * v for v in rows[8][1]]) for i in range(2)]  # the same direction
    odd = [None, [], [0.0] * d, [math.nan] + [1.0] * (d - 1), [math.inf] + [1.0] * (d - 1), [None] + [1.0] * (d - 1)]
    rows += [(2000 + i, v) for i, v in enumerate(odd)]
    rows += [(2100, [1.0, 2.0]), (2200, [1.0, 2.0]), (None, rows[0][1]), (5, rows[5][1])]
    return [(*r, 1, "x", "x", "x", "x") for r in rows]


def usable(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


def test_nearest_neighbours(spark):
    rows = vectors()
    table = spark.createDataFrame(rows, SCHEMA)
    got = hnsw.search(hnsw.index(table, 10), table.where("vec_id % 20 = 0"), 10).collect()
    points = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and usable(v)]
    hits = total = 0
    for q in {i for i, v in points if i % 20 == 0}:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        v = next(v for i, v in points if i == q)
        want = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in points if i != q and len(w) == len(v))[:10]
        assert [r["rank"] for r in mine] == list(range(1, len(want) + 1))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        for r in mine:
            assert any(i == r.vec_id and abs(np.sqrt(((w - v) ** 2).sum()) - r.score) < 1e-9 for i, w in points if len(w) == len(v))
        hits += len({r.vec_id for r in mine} & {i for _, i in want})
        total += len(want)
    assert hits >= 0.95 * total
    assert {r.query_id for r in got} == {i for i, _ in points if i % 20 == 0}
    none = spark.createDataFrame([], SCHEMA)
    assert hnsw.search(hnsw.index(none, 10), none, 10).collect() == []
    assert hnsw.search(hnsw.index(none, 10), table, 10).collect() == []


def test_graph_recall():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 24))
    _, links = hnsw.build(x)
    found = hnsw.nearest(x, links, x[:100], hnsw.EF_SEARCH)
    want = np.argsort(((x[:100, None, :] - x[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, want)]) >= 0.9


@pytest.mark.parametrize("tile", [4096, 40])
def test_embedding_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr("docsift.llm.embed_dedup.TILE", tile)
    rows = vectors()
    got = embedding_duplicates(spark.createDataFrame(rows, SCHEMA), 0.95).collect()
    assert len(got) == len(rows)
    points = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and usable(v)]
    low, links = {i: i for i, _ in points}, {}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i
    for a, (i, v) in enumerate(points):
        n = 0
        for b, (j, w) in enumerate(points):
            if a != b and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.95:
                n += 1
                p, q = root(i), root(j)
                low[max(p, q)] = min(p, q)
        links[i] = n
    assert max(links.values()) > 15
    for r in got:
        assert r.n_links == links.get(r.vec_id, 0)
        if r.vec_id is not None:
            assert r.component_id == (root(r.vec_id) if r.vec_id in low else r.vec_id)
        assert r.kept == (r.vec_id is None or r.vec_id == r.component_id)
    assert embedding_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_error_bounds_are_rigorous():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(200, 32))
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    q, s, e = quantise(u)
    got = q.astype(float) @ q.astype(float).T / np.outer(s, s)
    assert (np.abs(got - u @ u.T) <= e[:, None] + e[None] + np.outer(e, e)).all()


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i - 1) for i in range(1, 60)] + [(100 + i, 100) for i in range(1, 50)] + [
        (rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(6), "t").collect()}
    ids, low = roots(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert {i: r for i, r in zip(ids.tolist(), low.tolist()) if i in got} == got
    assert all(i in got for a, b in links if a != b for i in (a, b))
    assert components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


# --- pages

def page(main, i):
    return (f"<html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body><nav><ul><li>"
            f"<a href=/a>Home {i}</a><li><a href=/b>More</a></ul></nav><!-- x --><div class='ad'>Buy now</div><article>"
            f"<h1>{main[0]}</h1>" + "".join(f"<p><b>{m}</b><br>" for m in main[1:]) + "</article><footer>&copy; site</footer>")


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(9)
    texts = [[" ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(6, 40))) + "." for _ in range(4)] for _ in range(60)]
    rows = [(i, f"u{i}", page(t, i), "x") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    return table, texts, html_main.train(table)


def test_main_text_of_pages(spark, trained):
    table, texts, model = trained
    odd = [(100, "u", None, "x"), (101, None, "", "x"), (None, "u", page(texts[0], 0), "x"), (0, "u", page(texts[1], 0), "x"),
           (102, "u", page(["A &amp; B", "long " * 20000 + "end."], 0), "x")]
    got = html_main.extract(table.unionByName(spark.createDataFrame(odd, table.schema)), model).collect()
    assert len(got) == len(texts) + len(odd)
    want = {i: "\n\n".join(t) for i, t in enumerate(texts)}
    right = sum(r.text == want.get(r.page_id) for r in got)
    assert right >= 0.98 * len(texts)
    by = {r.page_id: r for r in got}
    assert by[100].text == "" and by[101].text == "" and by[100].n_chars == 0
    assert by[102].text.startswith("A & B\n\nlong long") and by[102].text.endswith("end.")
    assert all(r.n_chars == len(r.text) for r in got)
    none = spark.createDataFrame([], table.schema)
    assert html_main.extract(none, html_main.train(none)).collect() == []


@pytest.mark.parametrize("marked", [3, 300])
def test_labels_come_from_the_few_pages_that_mark_their_article(spark, marked):
    plain = "<body><div class=menu><a href=#>Main domains {0}</a></div><p>Some text of page {0}, which marks nothing.</p>"
    texts = [["A title", f"This is the text of page {i}, with some more words.", "It ends here, at last."] for i in range(marked)]
    rows = [(i, page(t, i)) for i, t in enumerate(texts)] + [(10_000 + i, plain.format(i)) for i in range(4000)]
    table = spark.createDataFrame(rows, "page_id long, html string").repartition(4)
    assert min(marked, 130) <= html_main.labelled_sample(table).count() <= 270
    model = html_main.train(table)
    assert [html_main.main_text(page(t, 0), model) for t in texts[:3]] == ["\n\n".join(t) for t in texts[:3]]


def test_other_layouts(trained):
    """Held-out layouts and texts: other tags and class words than the training pages have."""
    _, _, model = trained
    story = ["A long story begins here, with many words in it.", "It goes on for a while, and then some more.", "At last, it ends."]
    body = "".join(f"<p>{s}</p>" for s in story)
    for layout in ("<div class='navbar top'><a href=#>Home</a></div><div id='main-content' class=story>%s</div><div class='comments'>"
                   "<p>I liked it, said a reader.</p></div><div class=footer>All rights</div>",
                   "<header><h2>Site</h2></header><main class=page>%s</main><aside><p>Other things to read, too.</p></aside>"
                   "<form><p>Sign up now</p></form><footer><p>Imprint</p></footer>"):
        assert html_main.main_text(layout % body, model) == "\n\n".join(story)


def test_blocks():
    got = html_main.blocks("<p>a&nbsp;b\n <i>c</i><br>d<p>e<ul><li>f<li>g</ul>h<script>x</script>i<textarea>no</textarea><a href='>'>j</a>")
    assert [b.text for b in got] == ["a b c d", "e", "f", "g", "hij"] and got[-1].linked == 1


@pytest.mark.parametrize("piece", ["<a ", "<p x=\"", "<p x='\"", "<b>x", "<div>x", "<li/>", "<script ", "<b><hr>", "<!",
                                   "<i id=w><li/>x"])
def test_blocks_of_hostile_pages_take_linear_time(piece):
    model = {"weights": {"@div": (0.0, 1.0)}, "move": [[0.0] * 2] * 2, "start": [0.0] * 2}
    start = time.process_time()
    html_main.main_text(piece * ((1 << 20) // len(piece)), model)
    assert time.process_time() - start < 60  # quadratic reading takes hours


def test_tags_that_never_end():
    assert [b.text for b in html_main.blocks("<p>a</p><b x=\"<i>b</i><p>c' <u y='>d")] == ["a", "<b x=\"b", "c' <u y='>d"]
    assert [b.text for b in html_main.blocks("<p>a <b <script x")] == ["a <b <script x"]
    assert [b.text for b in html_main.blocks("<p>a <b <!-- c d")] == ["a <b"]


def test_decoding_is_viterbi(trained):
    """The best labelling of all, by trying every one; features outside the model don't count."""
    _, texts, model = trained
    got = html_main.features(html_main.blocks(page(texts[0], 1)))[:8]
    weight = lambda f, y: sum(model["weights"].get(x, (0.0, 0.0))[y] for x in f)
    def score(ys):
        return (model["start"][ys[0]] + sum(weight(f, y) for f, y in zip(got, ys))
                + sum(model["move"][a][b] for a, b in zip(ys, ys[1:])))
    assert html_main.decode(got, model) == list(max(itertools.product((0, 1), repeat=len(got)), key=score))


# --- queries and the pipeline

def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: (len(n.split("_")[0]), n)) if n != "pipeline"] == [
        f"op{i}" for i in range(1, 14)]
    assert set(ORACLES) <= set(QUERIES) and "pipeline" in QUERIES


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "repeats", "packing"]
    docs = docs_df(spark, documents() + [row(800, "x")])
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").where("doc_id is not null").collect())
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert not {100, 101, 107, 121} & set(ids(kept)) and {0, 1, 400, 800} <= set(ids(kept))
    cut = corpus_pipeline.cut_repeats(spark, kept, "")
    assert cut.columns == docs.columns and ids(cut) == ids(kept)
    assert all(r.n_chars == len(r.text) for r in cut.where("text is not null").collect())
    known = corpus_pipeline.drop_unknown_language(spark, kept, "")
    assert known.columns == docs.columns and not {400, 401, 402, 405} & set(ids(known))
    odd = kept.withColumns({"g_id": F.lit(1), "k_id": F.lit(2), "k_text": F.lit("t"), "n_words": F.lit(-1), "n_removed": F.lit(-2)})
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeats):
        for table in (odd, odd.union(odd.where("doc_id = 0").withColumn("text", F.lit("another text")))):
            out = stage(spark, table, "")
            assert out.columns == odd.columns
            assert {(r.g_id, r.k_id, r.k_text, r.n_words, r.n_removed) for r in out.collect()} == {(1, 2, "t", -1, -2)}
    packed = corpus_pipeline.pack_sequences(spark, cut, "").select("doc_id", "length", "doc_tokens", "start").collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
