"""The pipeline's stages over written tables against plain-Python versions (models as given)."""
import random
from collections import Counter

import pytest

import corpus_pipeline
from docsift.llm import language, toxicity
from docsift.llm.common import fold

from .fixtures_llm import docs_df, documents, row, sentence, words


def tainted(rng):
    w = sentence(rng, 40).split()
    w.insert(rng.randrange(40), rng.choice(["Vile!", "nasty,", "VILE"]))
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    """The awkward cases, labelled texts, and rows that share an id or have none."""
    rng = random.Random(21)
    out = documents() + [row(1000 + i, tainted(rng) if i % 4 == 0 else sentence(rng, 40)) for i in range(300)]
    out += [row(1400 + i, " ".join(rng.choice(["kalo", "lomi", "mika", "milo"]) for _ in range(20)), "aa") for i in range(80)]
    text = {d[0]: d[1] for d in out if d[0] is not None}
    edited = text[10] + " tail"
    out += [row(2000, tainted(rng)), row(2000, sentence(rng, 60)), row(None, tainted(rng)), row(None, sentence(rng, 30)),
            row(2001, "12 34"), row(2001, sentence(rng, 60)), row(None, "12 34"), row(None, None),
            # under one id: another text, a copy of a smaller id's, a near-copy of one
            row(2002, sentence(rng, 60)), row(2002, text[11]), row(2003, sentence(rng, 60)), row(2003, edited),
            row(2003, sentence(rng, 60)), row(2004, sentence(rng, 60))]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs_df(spark, rows).repartition(5).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(1000, 1300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def alone(rows):
    """Every row under an id of its own: its place."""
    return [(i, *d[1:]) for i, d in enumerate(rows)]


def plain_toxic(spark, rows, sf_dir):
    model = toxicity.train(docs_df(spark, rows), toxicity.known_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    bad = {r.doc_id for r in toxicity.score(docs_df(spark, alone(rows)), model).collect() if r.predicted}
    return [d for i, d in enumerate(rows) if i not in bad]


def plain_language(spark, rows, sf_dir):
    docs = docs_df(spark, rows)
    model = language.train(docs.where(fold(docs.doc_id) != 2))
    bad = {r.doc_id for r in language.predict(docs_df(spark, alone(rows)), model).collect() if r.rejected}
    return [d for i, d in enumerate(rows) if i not in bad]


def plain_near_duplicates(spark, rows, sf_dir):
    sets, low = [], list(range(len(rows)))
    for d in rows:
        w = words((d[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w and d[0] is not None else set())

    def root(i):
        while low[i] != i:
            i = low[i]
        return i
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                low[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, d in enumerate(rows):
        if d[0] is not None:
            least[root(i)] = min(least.get(root(i), d[0]), d[0])
    return [d for i, d in enumerate(rows) if d[0] is None or d[0] == least[root(i)]]


PLAIN = {"toxicity": plain_toxic, "language": plain_language, "near_duplicates": plain_near_duplicates}


@pytest.mark.parametrize("name", PLAIN)
def test_a_stage_judges_rows_not_ids(spark, rows, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs_df(spark, rows).repartition(5), sf_dir)
    assert got.columns == docs_df(spark, []).columns
    want = PLAIN[name](spark, rows, sf_dir)
    assert Counter(map(tuple, got.collect())) == Counter(want) and 0 < len(want) < len(rows)
    if name == "near_duplicates":
        assert Counter(d[0] for d in want if d[0] in (2002, 2003)) == {2002: 1, 2003: 2}
        one = [d for i, d in enumerate(rows) if d[0] is None or d[0] not in {e[0] for e in rows[:i]}]  # no id twice
        assert Counter(map(tuple, stage(spark, docs_df(spark, one), sf_dir).collect())) == Counter(PLAIN[name](spark, one, sf_dir))
