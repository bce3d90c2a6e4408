"""The pattern store, prompts and replies, the SQL surface, and de-duplication of features."""
import json
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docsift.functions.sql import register_functions, register_matcher
from docsift.operators.features import dedup_by_key
from docsift.operators.matching import attach_patterns, find_matches, prepare_patterns, regex_matches
from docsift.operators.prompts import prompt_text, replies_for
from docsift.sources.store import (append_counts, count_totals, delete_patterns, read_pattern_map, read_store,
                                   upsert_patterns)

PATTERNS = "pattern_id string, pattern_idx int, type string, expression string, feature_type string, industry string"


def test_pattern_map_round_trip(spark, tmp_path):
    rows = {"a.1": {"type": "regex", "expression": r"\d+", "feature_type": "n", "industry": "x", "examples": ["1", "22"],
                    "confidence": 0.5, "metadata": {"by": "me"}},
            "a.2": {"type": "fuzzy", "examples": []}, "bad": 5, "none": None, "untyped": {"expression": "q"}}
    (tmp_path / "one.json").write_text(json.dumps(rows))
    (tmp_path / "two.json").write_text("[1, 2")
    (tmp_path / "three.json").write_text("{}")
    good, rejected = read_pattern_map(spark, str(tmp_path))
    got = {r.pattern_id: {k: v for k, v in r.asDict().items() if k not in ("path", "pattern_id") and v is not None}
           for r in good.collect()}
    assert got == {k: rows[k] for k in ("a.1", "a.2")}
    assert sorted((r.pattern_id or "", r.path.rsplit("/", 1)[1]) for r in rejected.collect()) == [
        ("", "two.json"), ("bad", "one.json"), ("none", "one.json"), ("untyped", "one.json")]


def test_store_life_cycle(spark, tmp_path):
    path, counts = str(tmp_path / "patterns"), str(tmp_path / "counts")
    schema = "pattern_id string, examples array<string>, version int"
    first = spark.createDataFrame([(f"p{i}", ["x"], 1) for i in range(30)] + [(None, ["n"], 1), ("p0", ["late"], 2)], schema)
    second = spark.createDataFrame([("p1", ["y", "z"], 1), ("new", [], 1)], schema)
    read = lambda: {r.pattern_id: r.examples for r in read_store(spark, path).collect()}
    upsert_patterns(first, path, ["version"])
    upsert_patterns(second, path, ["version"])
    want = {f"p{i}": ["x"] for i in range(30)} | {"p0": ["late"], "p1": ["y", "z"], "new": []}
    assert read() == want
    upsert_patterns(second, path, ["version"])  # the same batch again
    upsert_patterns(second.limit(0), path, ["version"])
    assert read() == want
    delete_patterns(spark.createDataFrame([("p2",), ("unknown",)], "pattern_id string"), path)
    assert read() == {k: v for k, v in want.items() if k != "p2"}
    upsert_patterns(spark.createDataFrame([("p2", ["back"], 1)], schema), path, ["version"])
    assert read()["p2"] == ["back"]
    for batch in (0, 1, 1):
        append_counts(spark.createDataFrame([("p1", 2, 1)], "pattern_id string, tp int, fp int"), counts, batch)
    assert [(r.pattern_id, r.tp, r.fp) for r in count_totals(spark, counts).collect()] == [("p1", 4, 2)]


def test_replies_are_reused(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    docs = spark.createDataFrame([("a {text}", ["n1", "n2"]), (None, []), ("a {text}", ["n1", "n2"]), ("b", None)],
                                 "text string, names array<string>")
    prompts = docs.withColumn("prompt", prompt_text(F.col("text"), F.col("names"), "{features}T: {text}."))
    assert [r.prompt for r in prompts.collect()] == ["Look for: n1, n2\nT: a {text}.", "T: .", "Look for: n1, n2\nT: a {text}.", "T: b."]
    prompts = prompts.unionByName(prompts.limit(1).withColumn("prompt", F.lit(None).cast("string")))
    memo = spark.sql("""SELECT sha2(p, 256) AS prompt_hash, r AS reply, CAST(t AS TIMESTAMP) AS expires_at FROM VALUES
        ('T: b.', 'early', '2024-01-02'), ('T: b.', 'late', '2024-01-03'), ('T: .', 'expired', '2023-01-01') AS t(p, r, t)""")
    out, made = replies_for(prompts, memo, lambda d: d.withColumn("reply", F.length("prompt").cast("string")), now, 60)
    assert sorted((r.prompt or "-", r.reply, r.reused) for r in out.collect()) == [
        ("-", None, None), ("Look for: n1, n2\nT: a {text}.", "29", False), ("Look for: n1, n2\nT: a {text}.", "29", False),
        ("T: .", "4", False), ("T: b.", "late", True)]
    assert made.count() == 2


def test_matcher_in_sql_equals_the_matcher(spark):
    rows = [("p.digits", 0, "regex", r"\d*", "n", "x"), ("p.name", 1, "learned", r"(?P<a>Ann) (?P<b>Lee)?", "name", "x"),
            ("p.mark", 2, "regex", r"\$\d+\.\d\d", "amount", "y"), ("p.bad", 3, "regex", "(", "n", "x")]
    pats = prepare_patterns(spark.createDataFrame(rows, PATTERNS))
    docs = spark.createDataFrame([(1, "Ann Lee 12345", "x"), (2, "$12.50 x$3.00", "y"), (3, None, "x"), (4, "7", None),
                                  (5, " 777 ", "x"), (6, "", "y"), (None, "Ann  9", "x")], "doc_id long, text string, industry string")
    register_matcher(spark, pats, "matches_of")
    got = spark.sql("SELECT d.doc_id, m.* FROM {docs} d, LATERAL matches_of(text, industry) m", docs=docs).collect()
    want = regex_matches(attach_patterns(docs, pats)).select("doc_id", F.explode("regex_matches").alias("m")).collect()
    key = lambda r: (r[0] or 0, *map(str, r[1:]))
    assert sorted(((r.doc_id, r.pattern_id, r.match_text, r.match_start, round(r.confidence, 12)) for r in got), key=key) == sorted(
        ((r.doc_id, r.m.pattern_id, r.m.text, r.m.start, round(r.m.confidence, 12)) for r in want), key=key)
    assert got
    with pytest.raises(ValueError):
        register_matcher(spark, pats, "matches_of", most=1)


def test_scorers_in_sql(spark):
    register_functions(spark)
    r = spark.sql("""SELECT seq_ratio('Ring Blue', 'ring blau') AS s, levenshtein_ratio('abcd', 'abxd') AS l,
        levenshtein_ratio('', '') AS e, word_soundex('Robert') AS x, word_metaphone(CAST(NULL AS STRING)) AS m,
        phonetic_similarity('Smith', 'Smith') AS p, seq_ratio(NULL, 'a') AS n""").first()
    assert r.s == SequenceMatcher(None, "ring blue", "ring blau").ratio() and r.l == 0.75 and r.x == "R163" and r.p == 1.0
    assert r.e is None and r.m is None and r.n is None


def test_features_keep_first_place_and_last_payload(spark):
    schema = "a array<struct<type:string,value:string,n:int>>"
    rows = [[("t", "x", 1), ("u", None, 2), ("t", "x", 3), ("u", None, 4), (None, "x", 5), ("t", "y", 6), (None, "x", 7)], [], None,
            [(f"t{i % 10000}", "v", i) for i in range(20000)]]
    df = spark.createDataFrame([(r,) for r in rows], schema)
    start = time.time()
    got = [r.d for r in df.select(dedup_by_key(F.col("a")).alias("d")).collect()]
    assert time.time() - start < 60
    for r, d in zip(rows, got):
        want = None if r is None else [(*k, n) for k, n in {x[:2]: x[2] for x in r}.items()]
        assert (None if d is None else [tuple(x) for x in d]) == want


def test_fuzzy_matches_belong_to_a_text(spark):
    pats = prepare_patterns(spark.createDataFrame([("f", 0, "fuzzy", None, "w", "x", ["ring"])], PATTERNS + ", examples array<string>"))
    docs = spark.createDataFrame([(1, "a ring", "x"), (1, "other words here", "x"), (None, "ring", "x"), (2, "a ring", "x"), (2, "a ring", "x")],
                                 "doc_id long, text string, industry string")
    got = find_matches(attach_patterns(docs, pats)).collect()
    assert sorted((r.text, [m.text for m in r.matches]) for r in got) == [
        ("a ring", ["ring"])] * 3 + [("other words here", []), ("ring", ["ring"])]


def test_replies_are_parsed_once(spark):
    from docsift.plans.reply_queries import reply_features
    plan = reply_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(response") <= 2 and plan.count("split(") <= 4
