"""The document job (R1, S15): requests in, one result row each.

    request checks (F4, F8, unknown industry)  ->  failed rows
    unexpired result of the same content, industry and reply (J11, TTL)  ->  reused
    the rest, one row for each distinct content: parse the reply, rubric, industry chain,
    match with the industry's patterns, merge (H43), union of features (H44)

All in one plan: the only shuffles are those on the content hash; texts of rows that fail
or are reused are not parsed or matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import unexpired
from .features import dedup_features, pattern_features
from .matching import attach_patterns, find_matches, pattern_confidence
from .reply import parse_replies
from .requests import validate_requests
from .scoring import apply_rubrics, hybrid_merge, industry_adjust

PAYLOAD = ("doc_type", "confidence", "model_confidence", "pattern_confidence", "pattern_count", "features")


def request_key() -> Column:
    """What decides a result: content, industry and reply."""
    return F.sha2(F.to_json(F.struct("text", "industry", "response"), {"ignoreNullFields": "false"}), 256)


def classify(requests: DataFrame, patterns: DataFrame, required: DataFrame) -> DataFrame:
    """Adds ``PAYLOAD`` to valid requests (text, industry, response)."""
    d = industry_adjust(apply_rubrics(parse_replies(requests)), required)
    fuzzy = not patterns.filter("type = 'fuzzy'").isEmpty()
    d = pattern_confidence(find_matches(attach_patterns(d, patterns, no_industry="none"), fuzzy=fuzzy))
    d = dedup_features(d.withColumn("pattern_features", pattern_features(F.col("matches"))))
    merged = hybrid_merge(F.col("confidence"), F.col("pattern_confidence"), F.col("pattern_count"))
    return (d.withColumn("model_confidence", F.col("confidence")).withColumn("confidence", merged)
             .withColumn("features", F.col("merged_features")))


def process_documents(requests: DataFrame, results: DataFrame, patterns: DataFrame, required: DataFrame,
                      now: Column, ttl_seconds: int) -> DataFrame:
    """``requests``: doc_id, text, industry, response; ``results``: request_key, expires_at and
    ``PAYLOAD`` of earlier runs.  Returns doc_id, request_key, status, error, reused, processed_at,
    expires_at and ``PAYLOAD``; a row without an id or with a repeated one is a request of its own."""
    checked = (validate_requests(requests, required, content_col="text")
               .withColumn("request_key", request_key()))
    failed = checked.filter(F.col("error").isNotNull())
    valid = checked.filter(F.col("error").isNull())
    kept = (results.filter(unexpired(F.col("expires_at"), now)).groupBy("request_key")
            .agg(F.max_by(F.struct("expires_at", *PAYLOAD), F.coalesce("expires_at", F.lit("9999-12-31").cast("timestamp"))).alias("r"))
            .select("request_key", "r.*"))
    fresh = (valid.join(kept.select("request_key"), "request_key", "left_anti")
             .groupBy("request_key").agg(F.any_value(F.struct("doc_id", "text", "industry", "response")).alias("d"))
             .select("request_key", "d.*"))
    expires = now + F.make_interval(secs=F.lit(ttl_seconds))
    made = classify(fresh, patterns, required).select("request_key", expires.alias("expires_at"), *PAYLOAD, F.lit(False).alias("reused"))
    found = kept.withColumn("reused", F.lit(True)).select(made.columns).unionByName(made)
    done = (valid.select("doc_id", "request_key").join(found, "request_key")
            .withColumn("status", F.lit("completed")).withColumn("error", F.lit(None).cast("string")))
    bad = failed.select("doc_id", "request_key", F.lit("failed").alias("status"), "error", F.lit(False).alias("reused"))
    return done.unionByName(bad, allowMissingColumns=True).withColumn("processed_at", now)
