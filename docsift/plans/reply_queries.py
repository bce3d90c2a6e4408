"""Queries over rendered model replies: parsing, rubrics, industry chain, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import dedup_features, pattern_features
from ..operators.jobs import classify, process_documents, request_key
from ..operators.matching import (attach_patterns, find_matches, pattern_confidence,
                                  prepare_patterns)
from ..operators.reply import parse_replies
from ..operators.scoring import (apply_rubrics, confidence_band, hybrid_merge, industry_adjust,
                                 industry_required)
from ..sources.configs import config_patterns, config_rows, config_tables
from ..sources.render import customer_orders, reply_industry_sql, invoice_text_sql, replies, reply_select
from .matching_queries import resolved_sql, scored_matches_sql
from .registry import r6, register, values_sql
from .reply_sql import industry_ctes, parse_ctes, rubric_ctes


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_replies(replies(spark, sf_dir))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = config_tables(spark)
    return industry_adjust(apply_rubrics(_parsed(spark, sf_dir)), industry_required(cfg))


_PARSE = "WITH " + parse_ctes().lstrip()
_RUB = _PARSE + "," + rubric_ctes()
_IND = _RUB + "," + industry_ctes()


# --- H29-H31, A3, A4 ---------------------------------------------------------
@register("reply_features", _PARSE + """
SELECT doc_id::BIGINT AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord)::BIGINT AS seq,
       type AS feature_type, value AS feature_value, array_to_string(vals, '|') AS feature_values
FROM feats""")
def reply_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply lines -> typed features (key mapping, currency amounts, CPT and section lists)."""
    p = _parsed(spark, sf_dir)
    # the outer explode infers no filter on its array, which would repeat the parse
    return (p.select("doc_id", F.posexplode_outer("features").alias("pos", "f")).where("pos IS NOT NULL")
             .select(F.col("doc_id").cast("bigint").alias("doc_id"),
                     (F.col("pos") + 1).cast("bigint").alias("seq"),
                     F.col("f.type").alias("feature_type"), F.col("f.value").alias("feature_value"),
                     F.array_join("f.values", "|").alias("feature_values")))


# --- H29 header, H32, H33 ---------------------------------------------------
@register("normalized_doc_types", _PARSE + """
SELECT doc_id::BIGINT AS doc_id, doc_type, round(reply_confidence, 6) AS reply_confidence, multilingual FROM hdr""")
def normalized_doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document type normalisation, reply confidence line and multilingual flag."""
    p = _parsed(spark, sf_dir)
    return p.select(F.col("doc_id").cast("bigint").alias("doc_id"), "doc_type",
                    r6("reply_confidence").alias("reply_confidence"), "multilingual")


# --- H34-H39 ------------------------------------------------------------------
def _rubric(doc_type: str | None):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = apply_rubrics(_parsed(spark, sf_dir))
        if doc_type is not None:
            r = r.filter(F.col("doc_type") == doc_type)
        return r.select(F.col("doc_id").cast("bigint").alias("doc_id"), "doc_type",
                        r6("confidence").alias("confidence"))
    q.__doc__ = f"Rubric confidence for {doc_type or 'every'} document type (H34-H39)."
    return q


for _name, _dt in [("rubric_invoice", "invoice"), ("rubric_appraisal", "property_appraisal_report"),
                   ("rubric_contract", "legal_contract"), ("rubric_claim", "claim"),
                   ("rubric_prescription", "prescription"), ("rubric_default", None)]:
    _where = f"WHERE doc_type = '{_dt}'" if _dt else ""
    register(_name, _RUB + f"""
SELECT doc_id::BIGINT AS doc_id, doc_type, round(confidence, 6) AS confidence FROM rub {_where}""")(_rubric(_dt))


# --- H40, H41, J8, J12 --------------------------------------------------------
@register("industry_adjusted", _IND + """
SELECT doc_id::BIGINT AS doc_id, industry, doc_type, round(final_confidence, 6) AS confidence,
       array_to_string(missing, ',') AS missing_required FROM adj""")
def industry_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry validation chain: missing required, mixed signals, context checks, boosts."""
    c = _classified(spark, sf_dir).filter(F.col("missing_required").isNotNull())
    return c.select(F.col("doc_id").cast("bigint").alias("doc_id"), "industry", "doc_type",
                    r6("confidence").alias("confidence"),
                    F.array_join("missing_required", ",").alias("missing_required"))


@register("required_missing", _IND + """
SELECT doc_id::BIGINT AS doc_id, unnest(missing) AS feature_id FROM adj""")
def required_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required features of the industry that the reply lacks."""
    c = _classified(spark, sf_dir).filter(F.col("missing_required").isNotNull())
    return c.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                    F.explode("missing_required").alias("feature_id"))


# --- H42 (A5, A6) -------------------------------------------------------------
@register("amount_date_aggregate", _IND + """
SELECT r.doc_id::BIGINT AS doc_id,
  (list(f.value ORDER BY f.ord) FILTER (WHERE f.type = 'amount'))[1] AS amount_value,
  array_to_string(list(f.value ORDER BY f.ord) FILTER (WHERE f.type = 'amount'), '|') AS amount_values,
  (list(f.value ORDER BY f.ord) FILTER (WHERE f.type = 'date' OR ends_with(f.type, '_date')))[1] AS date_value,
  array_to_string(list(f.value ORDER BY f.ord) FILTER (WHERE f.type = 'date' OR ends_with(f.type, '_date')), '|') AS date_values
FROM rub r LEFT JOIN feats f ON r.doc_id = f.doc_id
WHERE r.doc_id NOT IN (SELECT doc_id FROM adj)
GROUP BY r.doc_id""")
def amount_date_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an industry: all amounts folded into one feature, all dates into another."""
    c = _classified(spark, sf_dir).filter(F.col("missing_required").isNull())
    amt = F.try_element_at(F.filter("features", lambda f: f["type"] == "amount"), F.lit(1))
    dat = F.try_element_at(F.filter("features", lambda f: f["type"] == "date"), F.lit(1))
    return c.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                    amt["value"].alias("amount_value"),
                    F.array_join(amt["values"], "|").alias("amount_values"),
                    dat["value"].alias("date_value"),
                    F.array_join(dat["values"], "|").alias("date_values"))


# --- F14 -----------------------------------------------------------------------
_TH = values_sql(config_rows()["industry_thresholds"], ["industry", "minimum", "high"])


@register("confidence_band", _IND + f""",
th AS ({_TH})
SELECT a.doc_id::BIGINT AS doc_id, a.industry, round(a.final_confidence, 6) AS confidence,
  CASE WHEN a.final_confidence >= th.high THEN 'high' WHEN a.final_confidence >= th.minimum THEN 'acceptable'
       ELSE 'low' END AS band
FROM adj a JOIN th ON a.industry = th.industry""")
def confidence_band_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence banding against the industry thresholds."""
    cfg = config_tables(spark)
    c = _classified(spark, sf_dir).filter(F.col("missing_required").isNotNull())
    c = c.join(F.broadcast(cfg["industry_thresholds"]), "industry")
    return c.select(F.col("doc_id").cast("bigint").alias("doc_id"), "industry",
                    r6("confidence").alias("confidence"),
                    confidence_band(F.col("confidence"), F.col("minimum"), F.col("high")).alias("band"))


# --- F13 -------------------------------------------------------------------------
_RULES = values_sql(config_rows()["industry_rules"], ["industry", "feature_id", "rule_type", "rule_value"])


@register("rule_violations", _IND + f""",
rules AS ({_RULES}),
cleaned AS (
  SELECT f.doc_id, a.industry, f.type,
    CASE WHEN f.type = 'cpt_code' AND regexp_matches(f.value, '\\d{{5}}') THEN regexp_extract(f.value, '(\\d{{5}})', 1)
         WHEN f.type = 'medical_code' AND f.value <> '' THEN regexp_replace(regexp_replace(f.value, '^ICD-?10\\s*', ''), '^\\s+|\\s+$', '', 'g')
         WHEN f.type = 'amount' AND f.value <> '' THEN regexp_replace(f.value, '[^\\d.]', '', 'g')
         ELSE f.value END AS value
  FROM feats f JOIN adj a ON f.doc_id = a.doc_id)
SELECT c.doc_id::BIGINT AS doc_id, c.type AS feature_type, c.value AS feature_value, r.rule_type,
  CASE WHEN r.rule_type = 'regex' THEN regexp_matches(c.value, r.rule_value)
       WHEN r.rule_type = 'length' THEN length(c.value) BETWEEN CAST(json_extract(r.rule_value, '$.min') AS BIGINT)
                                                          AND CAST(json_extract(r.rule_value, '$.max') AS BIGINT)
       ELSE true END AS rule_ok
FROM cleaned c JOIN rules r ON c.industry = r.industry AND c.type = r.feature_id""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-value validation rules from the config (regex / length) per feature."""
    from ..operators.validation import evaluate_rules
    cfg = config_tables(spark)
    c = _classified(spark, sf_dir).filter(F.col("missing_required").isNotNull())
    feats = (c.select("doc_id", "industry", F.explode("features").alias("f"))
              .select("doc_id", "industry", F.col("f.type").alias("feature_type"),
                      F.col("f.value").alias("feature_value"))
              .filter(F.col("feature_type") != "validation_warning"))
    out = evaluate_rules(feats, cfg["industry_rules"])
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "feature_type", "feature_value",
                      "rule_type", "rule_ok")


# --- J9 ----------------------------------------------------------------------------
_COND = values_sql(config_rows()["industry_conditional"], ["industry", "doc_type", "feature_id"])


@register("conditional_missing", _IND + f""",
cond AS ({_COND})
SELECT r.doc_id::BIGINT AS doc_id, c.feature_id
FROM rub r JOIN cond c ON r.industry = c.industry AND r.doc_type = c.doc_type
WHERE NOT list_contains(r.present, c.feature_id)""")
def conditional_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional requirements by document type (declared in config) that are unmet."""
    cfg = config_tables(spark)
    r = apply_rubrics(_parsed(spark, sf_dir)).filter(F.col("industry").isNotNull())
    present = F.array_distinct(F.transform(
        F.filter("features", lambda f: f["type"] != "document_type"), lambda f: f["type"]))
    r = r.withColumn("present", present)
    j = r.join(F.broadcast(cfg["industry_conditional"]), ["industry", "doc_type"])
    return (j.filter(~F.array_contains("present", F.col("feature_id")))
             .select(F.col("doc_id").cast("bigint").alias("doc_id"), "feature_id"))


# --- H43 -----------------------------------------------------------------------------
def _hybrid_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (customer_orders(spark, sf_dir)
             .selectExpr(*reply_select("spark"), f"{invoice_text_sql('spark')} AS text"))


_HYB_DOCS = ("SELECT " + ", ".join(reply_select("duck")) + f", {invoice_text_sql('duck')} AS text"
             + " FROM orders LEFT JOIN customer ON o_custkey = c_custkey")


@register("hybrid_merge", _IND + "," + scored_matches_sql(_HYB_DOCS, ["financial", "healthcare"])
          + "," + resolved_sql() + """,
pc AS (SELECT doc_id, avg(c) AS pconf, count(*) AS n FROM resolved GROUP BY doc_id),
model AS (SELECT r.doc_id, coalesce(a.final_confidence, r.confidence) AS mconf
          FROM rub r LEFT JOIN adj a ON r.doc_id = a.doc_id)
SELECT m.doc_id::BIGINT AS doc_id, round(m.mconf, 6) AS model_confidence,
       round(p.pconf, 6) AS pattern_confidence, coalesce(p.n, 0)::BIGINT AS pattern_count,
       round(CASE WHEN p.n > 0 THEN m.mconf * 0.6::DOUBLE + p.pconf * 0.4::DOUBLE ELSE m.mconf END, 6) AS confidence
FROM model m LEFT JOIN pc p ON m.doc_id = p.doc_id""")
def hybrid_merge_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model confidence merged with mean pattern-match confidence (patterns of the doc's industry)."""
    cfg = config_tables(spark)
    pats = prepare_patterns(config_patterns(spark))
    d = _hybrid_inputs(spark, sf_dir)
    d = industry_adjust(apply_rubrics(parse_replies(d)), industry_required(cfg))
    d = pattern_confidence(find_matches(attach_patterns(d, pats, no_industry="none"), fuzzy=False))
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                    r6("confidence").alias("model_confidence"),
                    r6("pattern_confidence").alias("pattern_confidence"),
                    F.col("pattern_count"),
                    r6(hybrid_merge(F.col("confidence"), F.col("pattern_confidence"),
                                    F.col("pattern_count"))).alias("confidence"))


# --- H44, W1, U1 -----------------------------------------------------------------------
@register("feature_union_dedup")
def feature_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model features + pattern features (all patterns when no industry), deduplicated
    by (type, value): first position, last writer's payload."""
    cfg = config_tables(spark)
    pats = prepare_patterns(config_patterns(spark))
    d = _hybrid_inputs(spark, sf_dir)
    d = industry_adjust(apply_rubrics(parse_replies(d)), industry_required(cfg))
    d = find_matches(attach_patterns(d, pats, no_industry="all"), fuzzy=False)
    d = dedup_features(d.withColumn("pattern_features", pattern_features(F.col("matches"))))
    return (d.select("doc_id", F.posexplode("merged_features").alias("pos", "f"))
             .select(F.col("doc_id").cast("bigint").alias("doc_id"),
                     (F.col("pos") + 1).cast("bigint").alias("seq"),
                     F.col("f.type").alias("feature_type"), F.col("f.value").alias("feature_value"),
                     F.col("f.source").alias("source")))


# --- R1, S15: the document job ------------------------------------------------------------
_JOB_NOW = "2024-06-01 00:00:00"


def _job_select(select: list[str], text: str) -> list[str]:
    """Hybrid inputs with some industries that aren't configured and some blank texts."""
    rest = [c for c in select if not c.endswith((" AS industry", " AS doc_id"))]
    return ["o_orderkey AS doc_id",
            f"CASE WHEN o_orderkey % 17 = 0 THEN 'marine' ELSE {reply_industry_sql()} END AS industry",
            *rest, f"CASE WHEN o_orderkey % 19 = 0 THEN '  ' ELSE {text} END AS text"]


@register("process_documents", _IND + "," + scored_matches_sql(_HYB_DOCS, ["financial", "healthcare"])
          + "," + resolved_sql() + """,
pc AS (SELECT doc_id, avg(c) AS pconf, count(*) AS n FROM resolved GROUP BY doc_id),
model AS (SELECT r.doc_id, r.industry, coalesce(a.final_confidence, r.confidence) AS mconf
          FROM rub r LEFT JOIN adj a ON r.doc_id = a.doc_id),
job AS (SELECT m.*, p.pconf, coalesce(p.n, 0) AS n,
          CASE WHEN m.doc_id % 19 = 0 THEN 'No content provided'
               WHEN m.doc_id % 17 = 0 THEN 'Invalid industry: marine' END AS error,
          m.doc_id % 7 = 0 AND m.doc_id % 2 = 1 AS cached
        FROM model m LEFT JOIN pc p ON m.doc_id = p.doc_id)
SELECT doc_id::BIGINT AS doc_id, CASE WHEN error IS NULL THEN 'completed' ELSE 'failed' END AS status, error,
       error IS NULL AND cached AS reused,
       CASE WHEN error IS NULL THEN CASE WHEN cached THEN 0 ELSE n END END::BIGINT AS pattern_count,
       CASE WHEN error IS NULL THEN CASE WHEN cached THEN 0.5 ELSE
         round(CASE WHEN n > 0 THEN mconf * 0.6::DOUBLE + pconf * 0.4::DOUBLE ELSE mconf END, 6) END END AS confidence
FROM job""")
def process_documents_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests checked, unexpired results reused, the rest classified, matched and merged."""
    cfg = config_tables(spark)
    requests = (customer_orders(spark, sf_dir)
                .selectExpr(*_job_select(reply_select("spark"), invoice_text_sql("spark"))))
    now = F.lit(_JOB_NOW).cast("timestamp")
    # results of an earlier run for every seventh request; those of even ids have expired
    none = F.lit(None)
    earlier = requests.filter("doc_id % 7 = 0").select(
        request_key().alias("request_key"),
        (now + F.when(F.col("doc_id") % 2 == 0, F.expr("INTERVAL -1 DAY")).otherwise(F.expr("INTERVAL 1 DAY"))).alias("expires_at"),
        none.cast("string").alias("doc_type"), F.lit(0.5).alias("confidence"), none.cast("double").alias("model_confidence"),
        none.cast("double").alias("pattern_confidence"), F.lit(0).cast("bigint").alias("pattern_count"),
        none.cast(_features_type(spark)).alias("features"))
    out = process_documents(requests, earlier, prepare_patterns(config_patterns(spark)), industry_required(cfg), now, 3600)
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "status", "error", "reused", "pattern_count",
                      r6("confidence").alias("confidence"))


def _features_type(spark: SparkSession):
    empty = spark.createDataFrame([], "doc_id bigint, text string, industry string, response string")
    cfg = config_tables(spark)
    return classify(empty, prepare_patterns(config_patterns(spark)), industry_required(cfg)).schema["features"].dataType
