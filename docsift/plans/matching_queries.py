"""Queries over rendered invoices: regex matching, resolution, per-document confidence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import (attach_patterns, find_matches, pattern_confidence,
                                  prepare_patterns, regex_matches)
from ..sources.configs import config_patterns, pattern_rows
from ..sources.render import INVOICES_DUCK, invoices
from .registry import r6, register, values_sql

MATCH_COLS = ["doc_id", "pattern_id", "feature_type", "match_text", "match_start",
              "match_end", "confidence"]


def _invoice_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pats = prepare_patterns(config_patterns(spark, only=["financial"]))
    return attach_patterns(invoices(spark, sf_dir), pats)


def _flat(df: DataFrame, col: str) -> DataFrame:
    return (df.select("doc_id", F.explode(col).alias("m"))
              .select(F.col("doc_id").cast("bigint").alias("doc_id"),
                      F.col("m.pattern_id").alias("pattern_id"),
                      F.col("m.feature_type").alias("feature_type"),
                      F.col("m.text").alias("match_text"),
                      F.col("m.start").cast("bigint").alias("match_start"),
                      F.col("m.end").cast("bigint").alias("match_end"),
                      r6("m.confidence").alias("confidence")))


# ---------------------------------------------------------------------------
# DuckDB oracle: an independent relational formulation (unnest + list ops)
# ---------------------------------------------------------------------------
def _pattern_values(only: list[str] | None, rows: list[tuple] | None = None) -> str:
    src = rows if rows is not None else pattern_rows(only=only)
    rows = [(pid, idx, expr, ft, ind, re.compile(expr).groups)
            for pid, idx, _t, expr, ft, ind in src]
    return values_sql(rows, ["pattern_id", "pattern_idx", "expr", "feature_type", "industry", "n_groups"])


def scored_matches_sql(docs_sql: str, only: list[str] | None, rows: list[tuple] | None = None) -> str:
    """CTE chain ending in ``scored`` (doc_id, pattern_id, pattern_idx, feature_type, mt, st, en, c)."""
    alnum = r"'^[\p{L}\p{N}]$'"
    return f"""
docs AS ({docs_sql}),
pats AS ({_pattern_values(only, rows)}),
pairs AS (
  SELECT d.doc_id, d.text, p.pattern_id, p.pattern_idx, p.feature_type, p.n_groups,
         regexp_extract_all(d.text, p.expr) AS ms, string_split_regex(d.text, p.expr) AS gs
  FROM docs d JOIN pats p ON d.industry = p.industry),
m0 AS (SELECT *, unnest(generate_series(1, len(ms))) AS k FROM pairs WHERE len(ms) > 0),
m1 AS (
  SELECT doc_id, text, pattern_id, pattern_idx, feature_type, n_groups, ms[k] AS mt,
         (coalesce(list_sum(list_transform(gs[1:k], lambda x: length(x))), 0)
          + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0))::BIGINT AS st
  FROM m0),
m2 AS (
  SELECT *, st + length(mt) AS en,
    CASE WHEN (st = 0 OR NOT regexp_matches(substring(text, st, 1), {alnum}))
          AND (st + length(mt) = length(text) OR NOT regexp_matches(substring(text, st + length(mt) + 1, 1), {alnum}))
         THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS boundary,
    CASE WHEN regexp_matches(mt, '^[\\p{{L}}\\p{{N}}_]+\\n?$') THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS word
  FROM m1),
m3 AS (
  SELECT *, 1.0::DOUBLE * 0.3::DOUBLE + least(1.0::DOUBLE, length(mt)::DOUBLE / 10) * 0.15::DOUBLE
            + least(1.0::DOUBLE, n_groups::DOUBLE / 3) * 0.1::DOUBLE + 1.0::DOUBLE * 0.2::DOUBLE
            + boundary * 0.15::DOUBLE + word * 0.1::DOUBLE AS c0
  FROM m2),
m4 AS (SELECT *, CASE WHEN word = 1 AND boundary = 1 THEN least(1.0::DOUBLE, c0 * 1.2::DOUBLE) ELSE c0 END AS c1 FROM m3),
m5 AS (SELECT *, CASE WHEN mt = regexp_replace(text, '^\\s+|\\s+$', '', 'g') THEN least(1.0::DOUBLE, c1 * 1.1::DOUBLE) ELSE c1 END AS c2 FROM m4),
m6 AS (SELECT *, CASE WHEN length(mt) < 3 AND word <> 1 THEN c2 * 0.8::DOUBLE ELSE c2 END AS c3 FROM m5),
m7 AS (SELECT *, CASE WHEN regexp_matches(mt, '[^\\p{{L}}\\p{{N}}_\\s]') THEN c3 * 0.9::DOUBLE ELSE c3 END AS c FROM m6),
scored AS (SELECT doc_id, pattern_id, pattern_idx, feature_type, mt, st, en, c FROM m7
           WHERE regexp_matches(mt, '\\S') AND c >= 0.6)"""


def resolved_sql() -> str:
    """CTEs ``grouped`` and ``resolved`` (one row per kept match)."""
    return """
grouped AS (
  SELECT doc_id, list_sort(list({'s': st, 'nc': -c, 'pi': pattern_idx, 'e': en, 'c': c,
                                 'pid': pattern_id, 'ft': feature_type, 'mt': mt})) AS l
  FROM scored GROUP BY doc_id),
folded AS (
  SELECT doc_id, list_reduce(l[2:len(l)], lambda acc, m:
      CASE WHEN m.s >= acc[-1].e THEN list_append(acc, m)
           WHEN m.c > acc[-1].c THEN list_append(acc[1:len(acc) - 1], m)
           ELSE acc END, [l[1]]) AS kept
  FROM grouped),
resolved AS (SELECT doc_id, unnest(kept, recursive := true) FROM folded)"""


def invoice_regex_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1+H2+F2+F3 via J1: every pattern match above threshold, before resolution."""
    return _flat(regex_matches(_invoice_docs(spark, sf_dir)), "regex_matches")


def resolved_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4 with T1+A9: overlap-resolved matches per document."""
    return _flat(find_matches(_invoice_docs(spark, sf_dir), fuzzy=False), "matches")


def doc_pattern_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: mean confidence and count of resolved matches per document."""
    d = pattern_confidence(find_matches(_invoice_docs(spark, sf_dir), fuzzy=False))
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                    F.col("pattern_count"), r6("pattern_confidence").alias("pattern_confidence"))


_BASE = "WITH " + scored_matches_sql(INVOICES_DUCK, ["financial"]).lstrip()

register("invoice_regex_matches", _BASE + """
SELECT doc_id::BIGINT AS doc_id, pattern_id, feature_type, mt AS match_text, st::BIGINT AS match_start,
       en::BIGINT AS match_end, round(c, 6) AS confidence FROM scored""")(invoice_regex_matches)

register("resolved_matches", _BASE + "," + resolved_sql() + """
SELECT doc_id::BIGINT AS doc_id, pid AS pattern_id, ft AS feature_type, mt AS match_text,
       s::BIGINT AS match_start, e::BIGINT AS match_end, round(c, 6) AS confidence FROM resolved""")(resolved_matches)

register("doc_pattern_confidence", _BASE + "," + resolved_sql() + """
SELECT d.doc_id::BIGINT AS doc_id, count(r.c)::BIGINT AS pattern_count, round(avg(r.c), 6) AS pattern_confidence
FROM docs d LEFT JOIN resolved r ON d.doc_id = r.doc_id GROUP BY d.doc_id""")(doc_pattern_confidence)
