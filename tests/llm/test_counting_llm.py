"""URL trees, collocations and centroids against SQL over the awkward cases; the quotient filter
and the drift bounds against brute force."""
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsift.llm import collocations as phrases
from docsift.llm import oracles, quotient
from docsift.llm.centroids import Round, assign, centroid_clusters, fall, squared
from docsift.llm.collocations import collocations
from docsift.llm.queries import URL_RULES
from docsift.llm.url_tree import DEPTH, judge

from .fixtures_llm import docs_df, documents, row, sentence


def by_sql(sql, name, df, path):
    df.write.parquet(f"{path}/{name}")
    con = duckdb.connect(config={"memory_limit": "2GB"})
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}/*.parquet')")
    got = con.sql(sql)
    return [dict(zip(got.columns, r)) for r in got.fetchall()]


def same(df, want):
    def key(r):
        return tuple((n, round(v, 9) if isinstance(v, float) else v) for n, v in sorted(r.items()))
    assert Counter(key(r.asDict()) for r in df.collect()) == Counter(map(key, want))


# -- URL tree -------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, path string, seg string, n string, purity string, template string, salt string"


def pages():
    rng = random.Random(3)
    urls = []
    for host in ("a.example.com", "WWW.b.example.com", "c.example.org", "d.example.net", "plain.net"):
        for lang in ("en", "fr", "de", "es"):
            urls += [f"http://{host}/{lang}/{rng.randrange(30000)}{rng.choice(['', '/', '.html', '.PHP?x=/de/1'])}" for _ in range(14)]
    urls += [f"https://shop.example.com/de/item-{i}/view" for i in range(30)] + [f"https://shop.example.com/fr/item-{i}/view" for i in range(3)]
    urls += [f"https://shop.example.com/sale/item-{i}/view" for i in range(9)] + [f"https://shop.example.com/de{i}/x" for i in range(5)]
    urls += ["http://org", "http://org/", "http://example.org/es", "http://x.example.org/es/", "http://notexample.org/es/1", "http://example.org/en/1?q",
             "ftp://com/de/#f", "http://user@h.com:80/de/x", None, "", "no scheme", "//half", "http://", "http:///de/", "http://q.com?de=/fr/",
             "HTTP://ÀB.COM/fr/ü", "http://e.com/" + "a/" * 40, "http://e.com/" + "x" * 50000, "http://t.com/{num}/=en", "http://t.com/de/\n/x",
             "one://two://three.com/fr/"]
    out = [(i, u, "h", *["x"] * 7) for i, u in enumerate(urls)]
    return out + [(3, urls[3], None, *["x"] * 7), (None, urls[5], None, *["x"] * 7), (900, urls[0], None, *["x"] * 7)]


@pytest.mark.parametrize("rules", [URL_RULES, [("allow", "com", ""), ("block", "b.com", "/"), ("block", "example.com", "/d")]])
def test_url_tree(spark, tmp_path, rules):
    table = spark.createDataFrame(pages(), PAGES).repartition(4)
    got = spark.createDataFrame(judge(table, rules).withColumn("purity", F.round("purity", 9)).toArrow())
    same(got, by_sql(oracles.url_tree(rules), "pages", table, tmp_path))
    rows = got.collect()
    assert len(rows) == len(pages())
    if rules == URL_RULES:
        assert {r.rule for r in rows} == {None, "org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"}
        unlabelled = {(r.host, r.verdict) for r in rows if r.host.endswith(".net")}
        assert len({v for _, v in unlabelled}) == 1  # the share of all urls


def test_url_tree_learns_a_template(spark):
    urls = [f"http://s.com/buy/{i}.php" for i in range(40)] + [f"http://s.com/news/{i}.html" for i in range(40)]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    # what the rules say of a few numbers is learned for all of their templates
    got = judge(table, [("block", "s.com", "/buy/1"), ("allow", "s.com", "/news/1")]).where("rule is null").collect()
    assert {(r.path.split("/")[1], r.verdict) for r in got} == {("buy", "block"), ("news", "allow")}
    assert {r.template for r in got} == {"/=buy/{num}.php", "/=news/{num}.html"}
    assert judge(table.where("page_id < 0"), []).collect() == []


def test_url_tree_without_labels(spark):
    table = spark.createDataFrame([(1, "http://a.b/c/d"), (2, "http://a.b/c/e"), (None, None)], "page_id long, url string")
    assert {(r.page_id, r.verdict) for r in judge(table, []).collect()} == {(1, "allow"), (2, "allow"), (None, "allow")}


# -- quotient filter and collocations ---------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.integers(2, 63), st.lists(st.lists(st.tuples(st.integers(0, (1 << 63) - 1), st.integers(1, 100_000)), max_size=40), min_size=1, max_size=4))
def test_quotient_filter(bits, shards):
    total, blocks = Counter(), []
    for shard in shards:
        mine = Counter()
        for key, n in shard:
            mine[key % (1 << bits)] += n
        total += mine
        keys = np.array(list(mine), np.uint64)
        values = quotient.permute(keys, bits)
        assert (quotient.unpermute(values, bits) == keys).all() and (len(keys) == 0 or int(values.max()) < 1 << bits)
        order = np.argsort(values)
        blocks.append(quotient.pack(values[order], np.array(list(mine.values()), np.int64)[order], bits))
        back, counts = quotient.unpack(blocks[-1])
        assert back.tolist() == values[order].tolist() and counts.tolist() == np.array(list(mine.values()), np.int64)[order].tolist()
    values, counts = quotient.merge(blocks)
    assert (np.diff(values.astype(object)) > 0).all()
    assert dict(zip(quotient.unpermute(values, bits).tolist(), counts.tolist())) == dict(total)


def test_permutation_is_one_to_one():
    for bits in (2, 3, 8, 13):
        assert sorted(quotient.permute(np.arange(1 << bits, dtype=np.uint64), bits).tolist()) == list(range(1 << bits))


def phrase_rows():
    rng = random.Random(8)
    rows = documents() + [row(600 + i, f"New York, city hall; new york CITY\nof the {rng.randrange(5)}.A a a a\ta") for i in range(12)]
    rows += [row(700, "new york\x0bcity\x0c hall\r of\x00the   x y", None), row(701, "...;!?", "de"), row(702, "éa Éa éa Éa " * 6, "fr")]
    return rows + [row(800 + i, sentence(rng, 90, 6), rng.choice(["de", "fr", None])) for i in range(12)]


@pytest.mark.parametrize("longest, least, percent, top, words", [(5, 4, 100, 2000, 300), (5, 6, 60, 25, 1 << 22), (3, 3, 100, 10, 50), (2, 5, 100, 7, 1 << 22)])
def test_collocations(spark, tmp_path, monkeypatch, longest, least, percent, top, words):
    monkeypatch.setattr(phrases, "RANGE_WORDS", words)  # several ranges
    table = docs_df(spark, phrase_rows()).repartition(5)
    want = by_sql(oracles.collocations(longest, least, percent, top), "documents", table, tmp_path)
    same(collocations(table, longest, least, percent, top), want)
    assert want and {w["lang"] for w in want} >= {"en", "und"}


def test_collocations_without_phrases(spark):
    assert collocations(docs_df(spark, [])).collect() == []
    few = docs_df(spark, [row(1, "a b"), row(2, None), row(3, "", None), row(None, "a. b")])
    assert collocations(few, least=5).collect() == []
    assert collocations(few, least=2).collect() == []  # words are frequent, no phrase is
    got = collocations(docs_df(spark, [row(i, "a b") for i in range(3)]), least=3).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", 3, 3, 3, 6, 2000)]


# -- centroids ------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, distance string, ids string, matrix string, v string, h string"


def vectors(n=260, d=8):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(6, d)) * 2
    rows = [(i, (middles[i % 6] + rng.normal(size=d) * 0.7).astype(np.float32).tolist()) for i in range(n)]
    rows += [(500 + i, rows[3][1]) for i in range(90)]  # copies
    nan, inf = float("nan"), float("inf")
    rows += [(700, None), (701, []), (702, [1.0] * (d + 1)), (703, [nan] * d), (704, [inf] + [0.0] * (d - 1)), (705, [None] + [0.0] * (d - 1)),
             (706, [0.0] * d), (None, rows[1][1]), (5, rows[9][1]), (5, rows[9][1]), (707, [1000.5] * d)]
    return [(*r, 1, *["x"] * 6) for r in rows]


@pytest.mark.parametrize("k, rounds", [(8, 10), (3, 4), (1, 2), (500, 2)])
def test_centroids(spark, tmp_path, k, rounds):
    table = spark.createDataFrame(vectors(), VECTORS).repartition(5)
    same(centroid_clusters(table, k, rounds, 8), by_sql(oracles.centroids(k, rounds, 8, 1024, "3"), "embeddings", table, tmp_path))


def test_centroids_of_few(spark):
    assert centroid_clusters(spark.createDataFrame([], VECTORS), 8, 10, 8).collect() == []
    assert centroid_clusters(spark.createDataFrame(vectors()[-11:-5], VECTORS), 8, 10, 8).collect() == []
    with pytest.raises(OverflowError):
        centroid_clusters(spark.createDataFrame([(1, [1e9] * 8, 1, *["x"] * 6)], VECTORS), 8, 10, 8)


def test_drift_bounds():
    rng = np.random.default_rng(9)
    tighter = 0
    for _ in range(300):
        d = rng.integers(1, 5)
        centre, old, new = rng.normal(size=(3, d)) * rng.choice([0.3, 3, 20])
        radius = abs(rng.normal()) * 2
        x = rng.normal(size=(400, d))
        x = centre + x / np.linalg.norm(x, axis=1, keepdims=True) * radius * rng.random((400, 1)) ** 0.2
        fell = np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)
        bound = fall(centre, radius, old, new)
        assert fell.max() <= bound <= np.linalg.norm(new - old) * (1 + 1e-6) + 1e-6 + 1e-9 * np.linalg.norm(centre - old)
        tighter += bound < 0.9 * np.linalg.norm(new - old)
    assert tighter > 100


def test_bounds_spare_scans():
    """Rounds with bounds give the assignments of full scans, and scan fewer vectors."""
    rng = np.random.default_rng(10)
    x = (rng.normal(size=(3000, 16)) * 300 + rng.integers(0, 5, (3000, 1)) * 900).astype(np.int64)
    r, cluster, lower, scanned = Round.of(x[:5].copy()), None, None, []
    for _ in range(12):
        cluster, lower, distance, n = assign(x, r, cluster, lower)
        full = squared(x, r.centroids)
        assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
        scanned.append(n)
        new = np.array([x[cluster == i].sum(axis=0) // max(1, (cluster == i).sum()) for i in range(5)])
        radius = np.array([np.sqrt(distance[cluster == i].max(initial=0)) for i in range(5)])
        r = Round.of(new, r.centroids, radius)
    assert scanned[0] == 3000 and scanned[-1] < 1500
    far = np.array([[1 << 26, -(1 << 26)], [5, 6]])
    assert squared(far, far).tolist() == [[0, ((1 << 26) - 5) ** 2 + ((1 << 26) + 6) ** 2], [((1 << 26) - 5) ** 2 + ((1 << 26) + 6) ** 2, 0]]


# -- splitting by the standard library --------------------------------------------------------------

def test_splitter_agrees():
    import public_tokenizers
    import regex

    from docsift.llm.tokens import PLAIN, splitter
    quick, full = splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN).findall
    rng = random.Random(12)
    for c in range(PLAIN + 16):  # every character in all kinds of company
        for text in (chr(c), f"a{chr(c)}1 {chr(c)}{chr(c)} b", f" {chr(c)}'s  {chr(c)}\n"):
            assert quick(text) == full(text), hex(c)
    some = "aZ09 '\t\n\x1c\x85\xa0 ’sé漢́ⅷ²!?'re'll"
    for _ in range(5000):
        text = "".join(rng.choice(some) for _ in range(rng.randrange(30)))
        assert quick(text) == full(text)
    other = r"\d+|\w"
    assert splitter(other)("a12") == ["a", "12"]
