"""Document-level operators: content hash reuse, fast path, text checks, previews.

All are column expressions or partially-aggregated group-bys:

* ``content_hash`` (H52), ``arg_cache_key`` (H53)
* ``dedup_by_hash`` (J11): one row per distinct content; map-side combined, so
  a content shared by a third of all documents is not a hot task
* ``cache_lookup`` (J11/R2): each document's result source (first document with
  the same hash) and whether it is a reuse
* ``long_document_fast_path`` (F9)
* ``text_quality`` (S5 ratios and the encoding verdict)
* ``best_variant`` (A13) with ``max_by`` (partial aggregation, first max wins)
* ``preview`` (S4/T3)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fixed_values import (LONG_DOC_AMOUNT_REGEX, LONG_DOC_CHARS, LONG_DOC_INVOICE_REGEX,
                                    LONG_DOC_NEWLINES, VARIANT_KEYWORDS)

NON_PRINTABLE = r"[\p{C}\p{Z}]"       # minus the plain space, counted separately
ALNUM_CHAR = r"[\p{L}\p{N}]"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def unexpired(expires_at: Column, now: Column) -> Column:
    """A result without an expiry stays; the others count until it."""
    return expires_at.isNull() | (expires_at > now)


def arg_cache_key(*parts: Column) -> Column:
    """First 16 hex chars of sha256 over '|'-joined parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def dedup_by_hash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    h = df.select(F.col(id_col), content_hash(F.col(text_col)).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.count("*").alias("n_docs"),
                                         F.min(id_col).alias("first_doc_id"))


def cache_lookup(df: DataFrame, results: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Join each document to the result table by content hash.

    ``results`` holds (content_hash, source_doc_id).  Hot hashes are split by
    AQE skew-join handling; the result side has one row per hash."""
    h = df.select(F.col(id_col), content_hash(F.col(text_col)).alias("content_hash"))
    j = h.join(results, "content_hash", "left")
    return j.withColumn("cache_hit", F.col("source_doc_id").isNotNull() & (F.col("source_doc_id") != F.col(id_col)))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "\n", ""))


def long_document_fast_path(df: DataFrame, text_col: str = "text") -> DataFrame:
    """long texts are typed 'invoice' at 0.8 with number/amount features, no model call."""
    t = F.col(text_col)
    is_long = (F.length(t) > LONG_DOC_CHARS) | (newline_count(t) > LONG_DOC_NEWLINES)
    inv = F.regexp_extract_all(t, F.lit(LONG_DOC_INVOICE_REGEX), 1)
    amt = F.regexp_extract_all(t, F.lit(LONG_DOC_AMOUNT_REGEX), 1)
    return (df.filter(is_long)
              .withColumn("doc_class", F.lit("invoice"))
              .withColumn("confidence", F.lit(0.8))
              .withColumn("invoice_numbers", inv)
              .withColumn("amounts", amt))


def _count(text: Column, regex: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, regex, ""))


def text_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Non-printable, alphanumeric and replacement-character counts and the verdict
    (short & >10 % non-printable, long & >50 %, alnum < 20 %, or any U+FFFD -> reject)."""
    t = F.col(text_col)
    n = F.length(t)
    spaces = F.length(t) - F.length(F.regexp_replace(t, " ", ""))
    nonprint = _count(t, NON_PRINTABLE) - spaces
    alnum = _count(t, ALNUM_CHAR)
    repl = F.length(t) - F.length(F.regexp_replace(t, "�", ""))
    denom = F.greatest(F.lit(1), n).cast("double")
    out = (df.withColumn("n_chars", n.cast("bigint"))
             .withColumn("non_printable", nonprint.cast("bigint"))
             .withColumn("alnum", alnum.cast("bigint"))
             .withColumn("replacement", repl.cast("bigint")))
    npr = F.col("non_printable") / denom
    anr = F.col("alnum") / denom
    bad = (((F.col("n_chars") < 50) & (npr > 0.1)) | ((F.col("n_chars") >= 50) & (npr > 0.5))
           | (anr < 0.2) | (F.col("replacement") > 0))
    return (out.withColumn("non_printable_ratio", npr).withColumn("alnum_ratio", anr)
               .withColumn("encoding_ok", ~bad))


def variant_score(text: Column) -> Column:
    """Alnum + 2 * digits + 10 per keyword present (upper-case)."""
    up = F.upper(text)
    kw = sum((F.when(up.contains(k), 10).otherwise(0) for k in VARIANT_KEYWORDS), F.lit(0))
    return (_count(text, ALNUM_CHAR) + 2 * _count(text, r"\p{Nd}") + kw).cast("bigint")


def best_variant(df: DataFrame, group_col: str, variant_col: str, text_col: str = "text") -> DataFrame:
    """Highest score per group; ties keep the earliest variant (``max(..., key=...)``)."""
    scored = df.withColumn("_score", variant_score(F.col(text_col)))
    key = F.struct(F.col("_score"), (-F.col(variant_col)).alias("_neg"))
    return scored.groupBy(group_col).agg(
        F.max_by(F.struct(F.col(variant_col).alias("variant"), F.col("_score").alias("score")), key).alias("b"),
        F.count("*").alias("n_variants")).select(group_col, "b.variant", "b.score", "n_variants")


def preview(df: DataFrame, text_col: str = "text", n_chars: int = 1000, n_lines: int = 5) -> DataFrame:
    """First characters, first lines and the line count."""
    t = F.col(text_col)
    lines = F.split(t, "\n", -1)
    return (df.withColumn("preview", F.substring(t, 1, n_chars))
              .withColumn("head_lines", F.array_join(F.slice(lines, 1, n_lines), "\n"))
              .withColumn("n_lines", F.size(lines).cast("bigint")))
