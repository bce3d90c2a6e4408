"""Request validation, default ids, JSON round trip, prompt dedup."""
from pyspark.sql import functions as F

from docsift.operators.requests import (default_document_id, dedup_prompts, from_json_column,
                                        to_json_column, validate_requests)


def test_validate_requests(spark):
    reqs = spark.createDataFrame([(1, "text", "financial"), (2, "  ", None), (3, "x", "mining"), (4, "y", None)],
                                 "id long, content string, industry string")
    inds = spark.createDataFrame([("financial",), ("healthcare",)], "industry string")
    got = {r.id: r.error for r in validate_requests(reqs, inds).collect()}
    assert got == {1: None, 2: "No content provided", 3: "Invalid industry: mining", 4: None}


def test_ids_json_prompts(spark):
    df = spark.createDataFrame([(None, "abc"), ("d1", "abc")], "doc_id string, content string")
    ids = [r[0] for r in df.select(default_document_id(F.col("doc_id"), F.col("content"))).collect()]
    assert ids[1] == "d1" and len(ids[0]) == 32
    j = df.select(to_json_column("doc_id", "content").alias("j"))
    back = j.select(from_json_column(F.col("j"), "doc_id string, content string").alias("r")).collect()
    assert back[1].r.doc_id == "d1"
    p = spark.createDataFrame([("p",), ("p",), ("q",)], "prompt string")
    assert dedup_prompts(p).count() == 2
