"""Context matching: sections, proximity, semantic concepts."""
import pytest
from pyspark.sql import functions as F

from docsift.operators.context import context_matches
from docsift.operators.matching import attach_patterns, prepare_patterns

SCHEMA = ("pattern_id string, pattern_idx int, type string, expression string, feature_type string, "
          "industry string, expected_section string")
CTX = ("struct<section_markers: array<struct<marker: string, type: string, level: int>>, "
       "nearby_features: array<struct<text: string, importance: double>>, concepts: array<string>>")


def run(spark, text, expr, expected, markers):
    docs = spark.createDataFrame([(0, "t", text, (markers, None, None))],
                                 f"doc_id long, industry string, text string, context {CTX}")
    p = prepare_patterns(spark.createDataFrame([("c", 0, "context", expr, "x", "t", expected)], SCHEMA))
    return context_matches(attach_patterns(docs, p)).select(F.explode("context_matches").alias("m")).collect()


def test_personal_info_golden(spark):
    out = run(spark, "Personal Information:\n123-45-6789", r"\b\d{3}-\d{2}-\d{4}\b", "personal_info",
              [("Personal Information:", "personal_info", 1)])
    assert len(out) == 1
    m = out[0].m
    assert m.section_type == "personal_info" and m.hierarchy_level == 1
    assert m.confidence == pytest.approx(0.7752, abs=1e-4)


def test_nested_sections(spark):
    out = run(spark, "Main:\nSub:\ntest word", r"\b\w+\b", "subsection",
              [("Main:", "main", 1), ("Sub:", "subsection", 2)])
    assert len(out) >= 1
    last = [o.m for o in out if o.m.text == "word"][0]
    assert last.section_type == "subsection" and last.hierarchy_level == 2
