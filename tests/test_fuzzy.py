"""Fuzzy word / name / address matching and similarity helpers (inline fixtures)."""
import random

import pytest
from pyspark.sql import functions as F

from docsift.functions.similarity import (metaphone_py, ngram_similarity, phonetic_similarity_py,
                                          soundex_py)
from docsift.operators import fuzzy
from docsift.operators.fuzzy import candidate_pairs, fuzzy_match_rows
from docsift.operators.matching import attach_patterns, prepare_patterns

SCHEMA = ("pattern_id string, pattern_idx int, type string, expression string, feature_type string, industry string, "
          "examples array<string>, is_name boolean, is_address boolean, min_confidence double")


def matched(spark, texts, examples, is_name=False, is_address=False):
    docs = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "doc_id long, industry string, text string")
    p = prepare_patterns(spark.createDataFrame(
        [("f", 0, "fuzzy", None, "x", "t", examples, is_name, is_address, None)], SCHEMA))
    rows = fuzzy_match_rows(attach_patterns(docs, p)).collect()
    return {texts[r.doc_id]: r.m for r in rows}


def test_word_mode(spark):
    got = matched(spark, ["test", "text", "testing", "completely different", ""], ["test", "text"])
    assert set(got) == {"test", "text", "testing"}


def test_address_mode(spark):
    texts = ["123 Main Street", "123 Main St", "Main Street 123", "456 Oak Ave", "123 Oak Street", "456 Main Street"]
    got = matched(spark, texts, ["123 Main St", "123 Main Street"], is_address=True)
    assert set(got) == {"123 Main Street", "123 Main St", "Main Street 123"}
    assert all(m.confidence >= 0.8 for m in got.values())


def test_name_mode(spark):
    got = matched(spark, ["John Smith", "Jane Doe"], ["John Smith", "Dr. John Smith", "Mr. Smith"], is_name=True)
    assert "John Smith" in got and got["John Smith"].confidence >= 0.9
    assert "Jane Doe" not in got


def test_phonetics():
    assert soundex_py("Robert") == "R163" and soundex_py("Rupert") == "R163" and soundex_py("Tymczak") == "T522"
    assert metaphone_py("Knight") == "NT" and metaphone_py("Smith") == metaphone_py("Smyth") == "SM0"
    assert metaphone_py("Philip") == "FLP"
    assert phonetic_similarity_py("smith", "smith") == pytest.approx(1.0)


def test_ngram_similarity(spark):
    df = spark.createDataFrame([("123 main street", "123 main st"), ("hello world", "hello world"),
                                ("abc", "xyz")], "a string, b string")
    got = [r[0] for r in df.select(ngram_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(1.0) and got[2] == 0.0


def plain_pairs(keys, examples, mode, min_confidence):
    """Every candidate with every example of its pattern; a null example matches nothing."""
    return (keys.filter(F.col("mode") == mode).join(examples, F.col("pattern_id") == F.col("e_pattern"))
            .filter(F.col("example").isNotNull()).select("mode", "pattern_id", "cand", "min_conf", "ex_idx", "example"))


@pytest.mark.parametrize("is_name", [False, True])
def test_candidate_pairs_lose_nothing(spark, monkeypatch, is_name):
    """The same scores as by all pairs, from a part of them."""
    rng = random.Random(11)
    syllables = ["ka", "lo", "mi", "ren", "tor", "sha", "phi", "du", "wex", "zu", "an", "er"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))

    def text():
        w = " ".join(word().title() for _ in range(rng.randrange(1, 4))) if is_name else word()
        return f"{rng.choice(['Dr. ', 'Mr. ', ''])}{w}" if is_name else w
    examples = list(dict.fromkeys(text() for _ in range(1500)))[:700]  # a set's order would change from run to run
    examples += ["", "a", "Aa", "aaaa", "aaaaaaaaaaaaaaaaaaaa", "12 Main Street", "12 Oak", "İstanbul", "ΟΔΟΣ", "Éa", "漢字テスト", " x ", "St."]

    def near(s):
        i = rng.randrange(len(s) + 1)
        return rng.choice([s, s[:i] + "q" + s[i:], s[:i], s + "s", s[1:], s.upper()])
    cands = {near(rng.choice(examples)) for _ in range(12)} | {text() for _ in range(4)} | {
        "aaaaaaaaaa", "12 main st", "istanbul", "οδος", "oδος", "éa", "漢字", "z" * 200}
    cands = {c if is_name else c.lower() for c in cands} - {""}
    mode = "name" if is_name else "word"
    keys = spark.createDataFrame([(mode, p, c) for p in ("p", "low") for c in cands], "mode string, pattern_id string, cand string")
    rows = [("p", None, i, e) for i, e in enumerate(examples)] + [("low", 0.9, i, e) for i, e in enumerate(examples[::20])]
    rows += [("low", 0.9, 9000, None), ("never", 0.2, 0, "ka")]
    table = spark.createDataFrame(rows, "e_pattern string, min_conf double, ex_idx int, example string")

    def result():
        got = fuzzy._score_word_name(keys, table, mode, 0.6)
        return {(r.pattern_id, r.cand, r.ex_idx): round(r.score, 9) for r in got.collect() if r.score >= (r.min_conf or 0.6)}
    met = candidate_pairs(keys, table, mode, 0.6).count()
    mine = result()
    monkeypatch.setattr(fuzzy, "candidate_pairs", plain_pairs)
    assert mine == result() and mine
    every = plain_pairs(keys, table, mode, 0.6).count()
    print(f"{mode}: {met} of {every} pairs")
    assert met < 0.6 * every


def test_candidate_pairs_of_any_threshold(spark):
    keys = spark.createDataFrame([("word", "p", "zzz"), ("word", None, "zzz"), ("name", "p", "zzz")], "mode string, pattern_id string, cand string")
    table = spark.createDataFrame([("p", 0.0, 0, "abc"), ("p", 0.0, 1, "")], "e_pattern string, min_conf double, ex_idx int, example string")
    for mode in ("word", "name"):
        assert candidate_pairs(keys, table, mode, 0.6).count() == 2  # nothing can be ruled out
