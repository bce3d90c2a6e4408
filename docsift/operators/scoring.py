"""Document scoring: per-type rubrics, industry adjustment, aggregation, merge.

All steps are column expressions over the ``features`` array of a parsed
reply row (see ``reply.parse_replies``); the per-industry configuration is a
handful of rows broadcast-joined by industry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fixed_values import FINANCIAL_SIGNALS, MEDICAL_SIGNALS
from ..functions.regex import let
from .reply import feature


def _types(feats: Column) -> Column:
    return F.array_distinct(F.transform(feats, lambda f: f["type"]))


def _has(present: Column, t: str) -> Column:
    return F.array_contains(present, F.lit(t))


def _missing_count(present: Column, required: list[str]) -> Column:
    return sum((F.when(_has(present, r), 0).otherwise(1) for r in required), F.lit(0))


def _set_equals(present: Column, items: list[str]) -> Column:
    return (F.size(present) == len(items)) & F.forall(present, lambda t: t.isin(*items))


def rubric_confidence(doc_type: Column, feats: Column, reply_conf: Column, multilingual: Column) -> Column:
    """Confidence from the document type's rubric (reply value otherwise)."""
    return let(F.struct(_types(feats).alias("present"),
                        F.size(F.filter(feats, lambda f: f["type"] == "amount")).alias("n_amount")),
               lambda v: _rubric(doc_type, v["present"], v["n_amount"], reply_conf, multilingual))


def _rubric(doc_type: Column, present: Column, n_amount: Column, reply_conf: Column, multilingual: Column) -> Column:
    # H34 invoice
    c = F.lit(0.7)
    c = F.when(n_amount > 1, F.least(F.lit(1.0), c + 0.1)).otherwise(c)
    c = F.when(_has(present, "invoice_number"), F.least(F.lit(1.0), c + 0.15)).otherwise(c)
    c = F.when(_has(present, "date"), F.least(F.lit(1.0), c + 0.1)).otherwise(c)
    c = F.when(_set_equals(present, ["amount", "invoice_number"]), F.least(c, F.lit(0.8))).otherwise(c)
    c = F.when(multilingual, F.least(F.lit(1.0), c + 0.15)).otherwise(c)
    invoice = F.when(_has(present, "amount"), c).otherwise(F.lit(0.5) - 0.2 * 1)
    # H35 appraisal
    req = ["report_id", "date", "property_address", "amount"]
    miss = _missing_count(present, req)
    appraisal = F.when(miss == 0, F.lit(0.9)).otherwise(F.lit(0.7) - 0.1 * miss)
    # H36 contract
    sec = F.exists(present, lambda t: t.isin("section", "clause"))
    miss_c = _missing_count(present, ["contract_id", "date"])
    contract = F.when((miss_c == 0) & sec, F.lit(0.9)).otherwise(
        F.when(sec, F.lit(0.5) + 0.1).otherwise(F.lit(0.5)))
    # H37 claim
    miss_cl = _missing_count(present, ["date", "cpt_code", "diagnosis", "provider"])
    claim = F.when(miss_cl == 0, F.lit(0.9)).otherwise(F.lit(0.7) - 0.1 * miss_cl)
    # H38 prescription
    patient = F.exists(present, lambda t: t.contains("patient"))
    rx = F.exists(present, lambda t: t.isin("prescription", "rx"))
    prescription = F.when(patient & rx, F.lit(0.8)).when(patient | rx, F.lit(0.6)).otherwise(reply_conf)
    out = (F.when(doc_type == "invoice", invoice)
           .when(doc_type == "property_appraisal_report", appraisal)
           .when(doc_type == "legal_contract", contract)
           .when(doc_type == "claim", claim)
           .when(doc_type == "prescription", prescription)
           .otherwise(reply_conf))
    return F.coalesce(out, F.lit(0.5))                       # H39


def apply_rubrics(df: DataFrame) -> DataFrame:
    """Adds ``confidence``; invoices also get a ``document_type`` feature."""
    conf = rubric_confidence(F.col("doc_type"), F.col("features"), F.col("reply_confidence"),
                             F.col("multilingual"))
    doc_feat = F.struct(F.lit("document_type").alias("type"), F.col("doc_type").alias("value"),
                        F.lit(None).cast("array<string>").alias("values"), F.lit(True).alias("present"))
    return (df.withColumn("confidence", conf)
              .withColumn("features", F.when(F.col("doc_type") == "invoice",
                                             F.concat("features", F.array(doc_feat)))
                          .otherwise(F.col("features"))))


def industry_required(config: dict[str, DataFrame]) -> DataFrame:
    """industry -> ordered required ids, one row for every configured industry."""
    req = config["industry_required"].withColumn("_i", F.monotonically_increasing_id())
    per = (req.groupBy("industry")
           .agg(F.array_sort(F.collect_list(F.struct("_i", "feature_id"))).alias("_r"))
           .select("industry", F.transform("_r", lambda x: x["feature_id"]).alias("required")))
    known = config["industry_thresholds"].select("industry").unionByName(per.select("industry")).distinct()
    return known.join(per, "industry", "left").select(
        "industry", F.coalesce("required", F.array().cast("array<string>")).alias("required"))


def _clean_value(f: Column) -> Column:
    """Cpt -> first 5 digits, medical_code -> drop ICD-10 prefix, amount -> digits and dots."""
    v = f["value"]
    cpt = F.when(v.rlike(r"\d{5}"), F.regexp_extract(v, r"(\d{5})", 1)).otherwise(v)
    med = F.when(v.isNotNull() & (v != ""),
                 F.regexp_replace(F.regexp_replace(v, r"^ICD-?10\s*", ""), r"(?U)^\s+|\s+$", "")).otherwise(v)
    amt = F.when(v.isNotNull() & (v != ""), F.regexp_replace(v, r"[^\d.]", "")).otherwise(v)
    newv = (F.when(f["type"] == "cpt_code", cpt).when(f["type"] == "medical_code", med)
            .when(f["type"] == "amount", amt).otherwise(v))
    return f.withField("value", newv)


def industry_adjust(df: DataFrame, required: DataFrame) -> DataFrame:
    """H40-H41 for rows with an industry and a type other than 'unknown'.

    Rows without an industry, or of type 'unknown', get the no-industry amount/date
    aggregation (H42).  An industry that isn't configured is an error of the row
    (``industry_error``): its features and confidence stay as they are."""
    df = df.join(F.broadcast(required), "industry", "left")  # by key, an industry's rows would meet in one task
    feats, conf = F.col("features"), F.col("confidence")
    unknown = F.col("industry").isNotNull() & F.col("required").isNull()
    req = F.coalesce(F.col("required"), F.array().cast("array<string>"))
    bound = let(_types(feats), lambda pr: F.struct(
        pr.alias("present"), F.filter(req, lambda r: ~F.array_contains(pr, r)).alias("missing"),
        F.exists(feats, lambda f: f["type"].isin(*MEDICAL_SIGNALS)).alias("medical"),
        F.exists(feats, lambda f: f["type"].isin(*FINANCIAL_SIGNALS)).alias("financial")))
    df = df.withColumn("_b", bound)
    present, missing = F.col("_b.present"), F.col("_b.missing")
    n_miss = F.size(missing)
    warn = F.struct(F.lit("validation_warning").alias("type"),
                    F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", ")).alias("value"),
                    F.array(F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", "))).alias("values"),
                    F.lit(True).alias("present"))
    feats2 = F.when(n_miss > 0, F.concat(feats, F.array(warn))).otherwise(feats)
    medical, financial = F.col("_b.medical"), F.col("_b.financial")
    c = F.when(n_miss > 0, F.greatest(F.lit(0.8), conf - 0.1 * F.least(F.lit(2), n_miss))).otherwise(conf)
    c = F.when(medical & financial, F.greatest(F.lit(0.7), c - 0.2)).otherwise(c)
    c = F.when(n_miss > F.floor(F.size(req) / 2), F.least(c * 0.8, F.lit(0.7))).otherwise(c)
    ind = F.col("industry")
    c = (F.when((ind == "healthcare") & ~medical, F.least(c * 0.8, F.lit(0.7)))
         .when((ind == "financial") & ~financial, F.least(c * 0.8, F.lit(0.7))).otherwise(c))
    c = F.when(n_miss == 0, F.least(F.lit(1.0), c * 1.2)).otherwise(c)
    c = F.when(_set_equals(present, ["amount", "invoice_number"]), F.least(c, F.lit(0.8))).otherwise(c)
    in_scope = ind.isNotNull() & (F.col("doc_type").isNull() | (F.col("doc_type") != "unknown"))
    agg = aggregate_amounts_dates(feats)
    in_scope = in_scope & ~unknown
    error = F.when(unknown, F.concat(F.lit("Invalid industry: "), ind))
    return (df.withColumn("missing_required", F.when(in_scope, missing))
              .withColumn("features", F.when(unknown, feats).when(in_scope, F.transform(feats2, _clean_value)).otherwise(agg))
              .withColumn("confidence", F.when(in_scope, c).otherwise(conf))
              .withColumn("industry_error", error)
              .drop("required", "_b"))


def aggregate_amounts_dates(feats: Column) -> Column:
    """H42 (A5, A6): fold amount features into one, then date / *_date features into one."""
    is_amt = lambda f: f["type"] == "amount"
    amts = F.transform(F.filter(feats, is_amt), lambda f: f["value"])
    step1 = F.when(F.size(amts) > 0, F.concat(
        F.filter(feats, lambda f: ~is_amt(f)),
        F.array(feature(F.lit("amount"), F.try_element_at(amts, F.lit(1)), amts)))).otherwise(feats)
    is_date = lambda f: (f["type"] == "date") | f["type"].endswith("_date")
    dates = F.transform(F.filter(step1, is_date), lambda f: f["value"])
    return F.when(F.size(dates) > 0, F.concat(
        F.filter(step1, lambda f: ~is_date(f)),
        F.array(feature(F.lit("date"), F.try_element_at(dates, F.lit(1)), dates)))).otherwise(step1)


def hybrid_merge(model_conf: Column, pattern_conf: Column, pattern_count: Column) -> Column:
    """0.6 * model + 0.4 * mean(match confidence) when there are matches."""
    return F.when(pattern_count > 0, model_conf * 0.6 + pattern_conf * 0.4).otherwise(model_conf)


def confidence_band(conf: Column, minimum: Column, high: Column) -> Column:
    """F14."""
    return (F.when(conf >= high, F.lit("high")).when(conf >= minimum, F.lit("acceptable"))
            .otherwise(F.lit("low")))
