"""Queries over the prose tables: contact matching, validation metrics, dedup,
result reuse, long-document path, text quality, best variant, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import (best_variant, cache_lookup, dedup_by_hash,
                                   long_document_fast_path, preview, text_quality)
from ..operators.matching import (attach_patterns, find_matches, prepare_patterns,
                                  regex_matches)
from ..operators.validation import confusion_metrics
from ..sources.fixed_values import PREDEFINED_FEATURE_REGEX
from ..sources.tables import DOCUMENTS_PER_TASK, spread, table
from .matching_queries import _flat, resolved_sql, scored_matches_sql
from .registry import r6, register

# unanchored forms of the learner's predefined email / phone / url regexes
CONTACT_ROWS = [(f"contact.{ft}", i, "regex", PREDEFINED_FEATURE_REGEX[ft].lstrip("^").rstrip("$"), ft, "contact")
                for i, ft in enumerate(["email", "phone", "url"])]
PATTERN_SCHEMA = "pattern_id string, pattern_idx int, type string, expression string, " \
                 "feature_type string, industry string"


def _contact_docs(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    pats = prepare_patterns(spark.createDataFrame(CONTACT_ROWS, PATTERN_SCHEMA))
    if docs is None:
        docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return attach_patterns(docs.withColumn("industry", F.lit("contact")), pats)


_DOCS_DUCK = "SELECT doc_id, 'contact' AS industry, text FROM documents"
_CONTACT = "WITH " + scored_matches_sql(_DOCS_DUCK, None, CONTACT_ROWS).lstrip()


@register("email_phone_documents", _CONTACT + "," + resolved_sql() + """
SELECT doc_id::BIGINT AS doc_id, pid AS pattern_id, ft AS feature_type, mt AS match_text,
       s::BIGINT AS match_start, e::BIGINT AS match_end, round(c, 6) AS confidence FROM resolved""")
def email_phone_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail, phone and URL matches over whole documents, scored and overlap-resolved."""
    return _flat(find_matches(_contact_docs(spark, sf_dir), fuzzy=False), "matches")


# a pattern that can match the empty string, a learned phrase and a plain pattern together
MIXED_ROWS = [("mixed.digits", 0, "regex", r"\d*", "digits", "contact"),
              ("mixed.license", 1, "learned", "General Public License", "license", "contact"),
              ("mixed.mail", 2, "regex", r"[a-z0-9]+@[a-z0-9]+\.[a-z]+", "mail", "contact")]
# SQL: the matches of \d* that aren't empty are those of \d+
_MIXED = "WITH " + scored_matches_sql(_DOCS_DUCK, None, [(*r[:3], r[3].replace("*", "+"), *r[4:]) for r in MIXED_ROWS]).lstrip()


@register("mixed_pattern_matches", _MIXED + """
SELECT doc_id::BIGINT AS doc_id, pattern_id, feature_type, mt AS match_text, st::BIGINT AS match_start,
       en::BIGINT AS match_end, round(c, 6) AS confidence FROM scored""")
def mixed_pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal, zero-width and learned patterns (H1, H3) in one set over whole documents."""
    pats = prepare_patterns(spark.createDataFrame(MIXED_ROWS, PATTERN_SCHEMA))
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    docs = spread(docs, docs.count(), DOCUMENTS_PER_TASK).withColumn("industry", F.lit("contact"))
    return _flat(regex_matches(attach_patterns(docs, pats)), "regex_matches")


@register("pattern_validation_metrics", _CONTACT + """,
lab AS (SELECT d.doc_id, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
lp AS (SELECT lab.doc_id, lab.toxic, p.pattern_id,
                 EXISTS (SELECT 1 FROM scored s WHERE s.doc_id = lab.doc_id AND s.pattern_id = p.pattern_id) AS flag
          FROM lab, pats p),
cnt AS (SELECT pattern_id,
          count(*) FILTER (WHERE flag AND toxic = 1) AS tp, count(*) FILTER (WHERE flag AND toxic <> 1) AS fp,
          count(*) FILTER (WHERE NOT flag AND toxic <> 1) AS tn, count(*) FILTER (WHERE NOT flag AND toxic = 1) AS fn
        FROM lp GROUP BY pattern_id),
vm AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS p,
                CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS r FROM cnt),
vm2 AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * (p * r) / (p + r) ELSE 0.0 END AS f1 FROM vm)
SELECT pattern_id, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn,
       round_even(p, 3) AS precision, round_even(r, 3) AS recall, round_even(f1, 3) AS f1,
       round_even(p * 0.4 + r * 0.4 + f1 * 0.2, 3) AS pattern_confidence FROM vm2""")
def pattern_validation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pattern confusion counts (match flag vs labels.toxic) -> precision/recall/F1/confidence."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    d = regex_matches(_contact_docs(spark, sf_dir, docs.join(labels, "doc_id")))
    flags = d.select("toxic", F.explode(F.transform("patterns", lambda p: F.struct(
        p["pattern_id"].alias("pattern_id"),
        F.exists("regex_matches", lambda m: m["pattern_id"] == p["pattern_id"]).alias("flag")))).alias("f"))
    truth = F.col("toxic") == 1
    flag = F.col("f.flag")
    cnt = flags.groupBy(F.col("f.pattern_id").alias("pattern_id")).agg(
        F.count_if(flag & truth).alias("tp"), F.count_if(flag & ~truth).alias("fp"),
        F.count_if(~flag & ~truth).alias("tn"), F.count_if(~flag & truth).alias("fn"))
    m = confusion_metrics(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return cnt.select("pattern_id", "tp", "fp", "tn", "fn", m["precision"].alias("precision"),
                      m["recall"].alias("recall"), m["f1"].alias("f1"),
                      m["pattern_confidence"].alias("pattern_confidence"))


@register("dedup_documents", """
SELECT sha256(text) AS content_hash, count(*)::BIGINT AS n_docs, min(doc_id)::BIGINT AS first_doc_id
FROM documents GROUP BY sha256(text)""")
def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct document contents by sha256 (partial aggregation; hot contents are combined map-side)."""
    d = dedup_by_hash(table(spark, sf_dir, "documents", "doc_id", "text"))
    return d.select("content_hash", F.col("n_docs").cast("bigint"), F.col("first_doc_id").cast("bigint"))


@register("cache_hits", """
WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents),
r AS (SELECT content_hash, min(doc_id) AS source_doc_id FROM h GROUP BY content_hash)
SELECT h.doc_id::BIGINT AS doc_id, h.content_hash, r.source_doc_id::BIGINT AS source_doc_id,
       (r.source_doc_id IS NOT NULL AND r.source_doc_id <> h.doc_id) AS cache_hit
FROM h LEFT JOIN r ON h.content_hash = r.content_hash""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result reuse by content hash: each document's source result and whether it is a hit."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    results = dedup_by_hash(docs).select("content_hash", F.col("first_doc_id").alias("source_doc_id"))
    j = cache_lookup(docs, results)
    return j.select(F.col("doc_id").cast("bigint"), "content_hash",
                    F.col("source_doc_id").cast("bigint"), "cache_hit")


@register("long_document_fast_path", """
SELECT doc_id::BIGINT AS doc_id, 'invoice' AS doc_class, 0.8::DOUBLE AS confidence,
       len(regexp_extract_all(text, 'Invoice Number: ([^\\n]+)', 1))::BIGINT AS n_invoice_numbers,
       len(regexp_extract_all(text, 'Amount: ([^\\n]+)', 1))::BIGINT AS n_amounts
FROM documents WHERE length(text) > 5000 OR length(text) - length(replace(text, chr(10), '')) > 200""")
def long_document_fast_path_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-document fast path: typed invoice at 0.8 with invoice-number / amount lists."""
    d = long_document_fast_path(table(spark, sf_dir, "documents", "doc_id", "text"))
    return d.select(F.col("doc_id").cast("bigint"), "doc_class", "confidence",
                    F.size("invoice_numbers").cast("bigint").alias("n_invoice_numbers"),
                    F.size("amounts").cast("bigint").alias("n_amounts"))


_TQ = """
SELECT src, id, n_chars, non_printable, alnum, replacement,
       round(non_printable::DOUBLE / greatest(1, n_chars), 6) AS non_printable_ratio,
       round(alnum::DOUBLE / greatest(1, n_chars), 6) AS alnum_ratio,
       NOT ((n_chars < 50 AND non_printable::DOUBLE / greatest(1, n_chars) > 0.1)
            OR (n_chars >= 50 AND non_printable::DOUBLE / greatest(1, n_chars) > 0.5)
            OR alnum::DOUBLE / greatest(1, n_chars) < 0.2 OR replacement > 0) AS encoding_ok
FROM (
  SELECT src, id, length(t)::BIGINT AS n_chars,
    (length(t) - length(regexp_replace(t, '[\\p{C}\\p{Z}]', '', 'g')) - (length(t) - length(replace(t, ' ', ''))))::BIGINT AS non_printable,
    (length(t) - length(regexp_replace(t, '[\\p{L}\\p{N}]', '', 'g')))::BIGINT AS alnum,
    (length(t) - length(replace(t, chr(65533), '')))::BIGINT AS replacement
  FROM (SELECT 'documents' AS src, doc_id AS id, text AS t FROM documents
        UNION ALL SELECT 'pages', page_id, html FROM pages))"""


@register("text_quality", _TQ)
def text_quality_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding-quality ratios and verdict over documents and raw pages."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    pages = table(spark, sf_dir, "pages", "page_id", "html").select(
        F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("t"))
    q = text_quality(docs.unionByName(pages), "t")
    return q.select("src", F.col("id").cast("bigint"), "n_chars", "non_printable", "alnum", "replacement",
                    r6("non_printable_ratio").alias("non_printable_ratio"),
                    r6("alnum_ratio").alias("alnum_ratio"), "encoding_ok")


@register("best_variant", """
WITH s AS (
  SELECT conv_id, turn,
    (length(text) - length(regexp_replace(text, '[\\p{L}\\p{N}]', '', 'g'))
     + 2 * (length(text) - length(regexp_replace(text, '\\p{Nd}', '', 'g')))
     + CASE WHEN contains(upper(text), 'INVOICE') THEN 10 ELSE 0 END
     + CASE WHEN contains(upper(text), 'TOTAL') THEN 10 ELSE 0 END
     + CASE WHEN contains(upper(text), 'AMOUNT') THEN 10 ELSE 0 END
     + CASE WHEN contains(upper(text), 'DATE') THEN 10 ELSE 0 END)::BIGINT AS score
  FROM conversations)
SELECT conv_id::BIGINT AS conv_id, arg_max(turn, (score, -turn))::BIGINT AS variant,
       max(score)::BIGINT AS score, count(*)::BIGINT AS n_variants
FROM s GROUP BY conv_id""")
def best_variant_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best text variant per group (conversation turns as variants): highest score, first wins."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    b = best_variant(c, "conv_id", "turn")
    return b.select(F.col("conv_id").cast("bigint"), F.col("variant").cast("bigint"),
                    F.col("score").cast("bigint"), F.col("n_variants").cast("bigint"))


@register("preview", """
SELECT doc_id::BIGINT AS doc_id, substring(text, 1, 1000) AS preview,
       array_to_string(string_split(text, chr(10))[1:5], chr(10)) AS head_lines,
       len(string_split(text, chr(10)))::BIGINT AS n_lines
FROM documents""")
def preview_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File preview: first 1000 characters, first five lines, line count."""
    p = preview(table(spark, sf_dir, "documents", "doc_id", "text"))
    return p.select(F.col("doc_id").cast("bigint"), "preview", "head_lines", "n_lines")
