"""Regex matching, confidence goldens, lint, overlap resolution."""
import pytest
from pyspark.sql import functions as F

from docsift.functions.regex import lint_issues, profile
from docsift.operators.matching import attach_patterns, find_matches, prepare_patterns, regex_matches

SCHEMA = "pattern_id string, pattern_idx int, type string, expression string, feature_type string, industry string"


def run(spark, texts, pats, resolve=False, minimum=0.6):
    docs = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "doc_id long, industry string, text string")
    p = prepare_patterns(spark.createDataFrame([(f"p{i}", i, "regex", e, f, "t") for i, (e, f) in enumerate(pats)], SCHEMA))
    d = attach_patterns(docs, p)
    d = find_matches(d, fuzzy=False) if resolve else regex_matches(d, min_confidence=minimum)
    col = "matches" if resolve else "regex_matches"
    return [(r.doc_id, m.feature_type, m.text, m.start, m.end, m.confidence)
            for r in d.select("doc_id", col).collect() for m in r[col]]


def test_email_whole_text_golden(spark):
    out = run(spark, ["test@example.com"], [(r"\b\w+@\w+\.\w+\b", "email")])
    assert len(out) == 1 and out[0][5] == pytest.approx(0.8712)


def test_date_and_amount_goldens(spark):
    text = "The invoice date is 2024-01-01 and the amount is $100.00."
    out = {m[1]: m for m in run(spark, [text], [(r"\d{4}-\d{2}-\d{2}", "date"), (r"\$\d+\.\d{2}", "amount")])}
    assert out["date"][5] == pytest.approx(0.792)
    assert out["amount"][5] == pytest.approx(0.7515)
    for _, _, t, s, e, _ in out.values():
        assert text[s:e] == t


def test_invalid_and_empty_patterns_match_nothing(spark):
    assert run(spark, ["test text"], [("[invalid", "x")]) == []
    assert run(spark, ["test text"], [("", "x")]) == []


def test_offsets_against_python(spark):
    import re
    text = "ab 12 cd 345 x 6\n7890 end 11"
    out = run(spark, [text], [(r"\d+", "num")])
    got = [(s, e) for _, _, _, s, e, _ in out]
    want = [m.span() for m in re.finditer(r"\d+", text)]
    assert sorted(got) == sorted(want)


def test_resolution_never_overlaps(spark):
    text = "Invoice Number: INV-2024-001 Date 2024-01-05 Total $1,000.00 Net 30 Terms: Net 30"
    pats = [(r"(?:INV|INVOICE)[-:]?\s*[A-Z0-9-]+", "a"), (r"[A-Z0-9]+-\d{4}-\d{3,}", "b"),
            (r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", "c"), (r"\d{4}-\d{2}-\d{2}", "d"),
            (r"Net\s+\d+", "e"), (r"Terms[-:]?\s*Net\s*\d+", "f")]
    out = sorted(run(spark, [text], pats, resolve=True), key=lambda m: m[3])
    for a, b in zip(out, out[1:]):
        assert b[3] >= a[4]
    for m in out:
        assert 0 <= m[5] <= 1 and text[m[3]:m[4]] == m[2]


def test_named_groups_and_translation(spark):
    docs = spark.createDataFrame([(0, "t", "id 42 and 7")], "doc_id long, industry string, text string")
    p = prepare_patterns(spark.createDataFrame([("p", 0, "regex", r"(?P<n>\d+)", "n", "t")], SCHEMA))
    r = regex_matches(attach_patterns(docs, p)).select(F.explode("regex_matches").alias("m")).collect()
    assert [m.m.named_groups["n"] for m in r] == ["42", "7"]


def test_lint_rules():
    assert lint_issues(".*.*") and lint_issues("a*b*c*d*e") and lint_issues(".*abc.*")
    assert lint_issues(".*.*", allow_inefficient=True) == []
    assert lint_issues("[(]")              # parenthesis inside a class still counts (kept)
    assert not profile("[invalid")["is_valid"] and profile(r"\d+")["is_valid"]
    assert not profile(None)["is_valid"] and profile(r"(?P<a>x)(y)")["named_idx"] == [1]
    assert lint_issues("[[]") and lint_issues("a)(") and not lint_issues(r"\[a\] \(b")


def test_matches_equal_finditer_over_a_grid(spark):
    """Every pattern on every text: mixed zero-width sets, Java-invalid and Java-divergent syntax."""
    import re
    pats = [r"\d+", r"x*\w*", r"\d{,3}", r"Ref: .+", r"\w+ \d+$", r"[A-Z&&D]+", r"\bé\w*", r"(?P<n>\d+)-(?P=n)", r"a|", r"\Z", r"(?i)total"]
    texts = ["abc 123", "Ref: 12\r\nnext 34\r", "R&D 7", "", " \n ", "été 55-55 TOTAL", "x" * 50 + " 9", "A\u2028B 3\n"]
    got = run(spark, texts, [(p, str(i)) for i, p in enumerate(pats)], minimum=0.0)
    want = {(d, str(i), m.group(), m.start(), m.end()) for d, t in enumerate(texts) for i, p in enumerate(pats)
            if profile(p)["is_valid"] for m in re.finditer(p, t) if m.group().strip()}
    assert {g[:5] for g in got} == want and len(got) == len(want)


def test_many_matches_in_one_text_scale_linearly(spark):
    import time
    taken = []
    for n in (20_000, 20_000, 80_000):
        start = time.time()
        assert len(run(spark, ["n1 " * n], [(r"n\d", "n")], resolve=True)) == n
        taken.append(time.time() - start)
    assert taken[2] < 8 * taken[1] + 10


def test_documents_without_industry_and_split_broadcasts(spark):
    docs = spark.createDataFrame([(0, "t", "a1"), (1, None, "a1"), (2, "none", "a1")], "doc_id long, industry string, text string")
    p = prepare_patterns(spark.createDataFrame([(f"p{i}", i, "regex", r"a\d", f"f{i}", "t" if i % 2 else "u") for i in range(6)], SCHEMA))
    for size in (100, 2):
        got = {r.doc_id: [x.pattern_idx for x in r.patterns] for r in attach_patterns(docs, p, "all", size).collect()}
        assert got == {0: [1, 3, 5], 1: [0, 1, 2, 3, 4, 5], 2: []}
        assert {r.doc_id: len(r.patterns) for r in attach_patterns(docs, p, "none", size).collect()} == {0: 3, 1: 0, 2: 0}


def test_learned_patterns_match(spark):
    docs = spark.createDataFrame([(0, "t", "Acme GmbH and more")], "doc_id long, industry string, text string")
    p = prepare_patterns(spark.createDataFrame([("p", 0, "learned", "Acme GmbH", "company", "t")], SCHEMA))
    assert [m.text for m in regex_matches(attach_patterns(docs, p)).first().regex_matches] == ["Acme GmbH"]
