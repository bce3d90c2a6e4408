"""Reply parsing, rubrics, industry chain, hybrid merge (inline fixtures)."""
import pytest
from pyspark.sql import functions as F

from docsift.operators.reply import parse_replies
from docsift.operators.scoring import apply_rubrics, hybrid_merge, industry_adjust, industry_required
from docsift.sources.configs import config_tables



def reply(kind, confidence, **sections):
    """A model reply: a type, a confidence, and numbered sections of facts."""
    lines = [f"Document Type: {kind}", f"Confidence: {confidence}", "", "Features:"]
    for number, (title, facts) in enumerate(sections.items(), 1):
        lines += [f"{number}. {title.replace('_', ' ')}", *(f"- {f}" for f in facts), ""]
    return "\n".join(lines)


HEALTH = reply("medical_claim", 0.95,
               Who=["Patient ID: K-77", "Date: 11/02/2023", "Provider: Dr. Ruth Okafor", "NPI: 5550001112"],
               Codes=["CPT Code: 97110 (Therapy)", "CPT Code: 71046 (Imaging)", "ICD-10: M54.5"],
               Costs=["Amount: $80.00", "Amount: $40.50", "Total Amount: $120.50"],
               Cover=["Insurance Claim: Q-9001"])
FIN = reply("invoice", 0.92,
            Paper=["Invoice Number: 2023/118", "Date: 11/02/2023"],
            Sums=["Amount: $2,400.00", "Amount: $100.00", "Total Amount: $2,500.00"],
            Terms=["Payment Terms: Net 15", "Due Date: 11/17/2023"])
MIXED = reply("medical_claim", 0.6, Care=["Patient ID: K-78", "CPT Code: 97110 (Therapy)"],
              Bill=["Invoice Number: 2023/119", "Amount: $80.00"])
INCOMPLETE = reply("medical_claim", 0.4, Known=["Date: 11/02/2023", "Amount: $80.00"])


def classify(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, industry string, response string")
    cfg = config_tables(spark)
    out = industry_adjust(apply_rubrics(parse_replies(df)), industry_required(cfg))
    return {r.doc_id: r for r in out.collect()}


def test_without_industry(spark):
    r = classify(spark, [(1, None, HEALTH), (2, None, FIN)])
    assert r[1].doc_type == "medical_claim" and r[1].confidence == pytest.approx(0.95)
    assert r[2].doc_type == "invoice" and r[2].confidence == pytest.approx(1.0)
    amount = [f for f in r[2].features if f.type == "amount"][0]
    assert len(amount["values"]) == 6 and amount.value == "$2,400.00"
    date = [f for f in r[2].features if f.type == "date"][0]
    assert date["values"] == ["11/02/2023", "11/17/2023"]


def test_with_industry(spark):
    r = classify(spark, [(1, "healthcare", HEALTH), (2, "financial", FIN), (3, "healthcare", MIXED),
                         (4, "healthcare", INCOMPLETE)])
    assert r[1].confidence == pytest.approx(0.85)
    assert sum(f.type == "validation_warning" for f in r[1].features) == 1
    assert r[2].confidence == pytest.approx(1.0)
    assert r[3].confidence == pytest.approx(0.56)
    assert r[4].confidence == pytest.approx(0.512)
    amounts = [f.value for f in r[2].features if f.type == "amount"]
    assert "2400.00" in amounts                       # industry path strips to digits and dots


def test_doc_type_normalisation(spark):
    from docsift.operators.reply import normalize_doc_type
    df = spark.createDataFrame([(s,) for s in ["Bill", "The Unknown Document", "Medical Claim", "RX",
                                               "Account Statement", "legal contract form"]], "s string")
    got = [r[0] for r in df.select(normalize_doc_type(F.col("s"))).collect()]
    assert got == ["invoice", "unknown", "claim", "prescription", "bank_statement", "legal_contract"]


def test_hybrid_merge_golden(spark):
    v = spark.range(1).select(hybrid_merge(F.lit(0.8), F.lit(0.9), F.lit(1)).alias("c")).first().c
    assert v == pytest.approx(0.84)


def test_unknown_industry_is_an_error_and_not_boosted(spark):
    r = classify(spark, [(1, "marine", MIXED), (2, "healthcare", MIXED)])
    assert r[1].industry_error == "Invalid industry: marine" and r[1].confidence == pytest.approx(0.6)
    assert r[2].industry_error is None


def test_range_and_enum_rules(spark):
    from docsift.operators.validation import evaluate_rules
    feats = spark.createDataFrame([("t", "n", v) for v in ("5", "$1,999", "x", None)] + [("t", "e", "a"), ("t", "e", "z")],
                                  "industry string, feature_type string, feature_value string")
    rules = spark.createDataFrame([("t", "n", "range", '{"min": 0, "max": 10}'), ("t", "e", "enum", '["a", "b"]'),
                                   ("t", "e", "regex", "[a-y]"), ("t", "n", "length", '{"max": 2}')],
                                  "industry string, feature_id string, rule_type string, rule_value string")
    got = {(r.feature_value, r.rule_type): r.rule_ok for r in evaluate_rules(feats, rules).collect()}
    assert got == {("5", "range"): True, ("$1,999", "range"): False, ("x", "range"): False, (None, "range"): None,
                   ("a", "enum"): True, ("z", "enum"): False, ("a", "regex"): True, ("z", "regex"): False,
                   ("5", "length"): True, ("$1,999", "length"): False, ("x", "length"): True, (None, "length"): None}


def test_phonetics_of_words_without_letters():
    from docsift.functions.similarity import phonetic_similarity_py
    assert phonetic_similarity_py("11", "99") < 0.1 and phonetic_similarity_py("11", "11") == 1.0
