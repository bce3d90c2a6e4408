"""Context-matching queries over sectioned statements rendered from ``orders``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.context import context_matches
from ..operators.matching import attach_patterns, find_matches, prepare_patterns
from ..sources.render import _money
from ..sources.tables import table
from .matching_queries import scored_matches_sql
from .registry import r6, register, sql_str, values_sql

# one context profile for every statement (section markers, nearby features, concepts)
MARKERS = [("Personal Information:", "personal_info", 1), ("Billing:", "billing", 1),
           ("Details:", "billing_details", 2), ("Notes:", "notes", 1)]
NEARBY = [("Total", 1.0), ("SSN", 2.0)]
CONCEPTS = ["identity", "payment"]
CONTEXT_PATTERNS = [
    # id, idx, expression, feature, expected section, concepts, (w_section, w_proximity, w_semantic)
    ("ctx.ssn", 0, r"\b\d{3}-\d{2}-\d{4}\b", "ssn", "personal_info", ["identity"], None),
    ("ctx.amount", 1, r"\$\d+(?:\.\d{2})?", "amount", "billing", ["payment", "amount"], None),
    ("ctx.ref", 2, r"\bREF-\d+\b", "reference", "billing_details", ["reference"], (0.5, 0.2, 0.3)),
]

STATEMENT_TEXT = (
    "concat_ws(chr(10), 'ACCOUNT SUMMARY', "
    "CASE WHEN o_orderkey % 4 <> 3 THEN 'Personal Information:' END, "
    "'Customer: ' || c_name, "
    "'SSN: ' || CAST(100 + o_orderkey % 900 AS STRING) || '-' || CAST(10 + o_orderkey % 90 AS STRING) "
    "|| '-' || CAST(1000 + o_orderkey % 9000 AS STRING), "
    "CASE WHEN o_orderkey % 5 <> 4 THEN 'Billing:' END, "
    f"'Total: $' || {_money('o_totalprice')}, "
    "CASE WHEN o_orderkey % 2 = 0 THEN 'Details:' END, "
    "'REF-' || CAST(o_orderkey AS STRING) || ' posted', "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'Notes:' END, 'Net 30')")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
             .selectExpr("o_orderkey AS doc_id", "'statements' AS industry", f"{STATEMENT_TEXT} AS text"))


def context_column() -> F.Column:
    return F.struct(
        F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(t).alias("type"), F.lit(lv).alias("level"))
                  for m, t, lv in MARKERS]).alias("section_markers"),
        F.array(*[F.struct(F.lit(t).alias("text"), F.lit(w).alias("importance")) for t, w in NEARBY])
         .alias("nearby_features"),
        F.array(*[F.lit(c) for c in CONCEPTS]).alias("concepts"))


def context_patterns(spark: SparkSession) -> DataFrame:
    rows = [(pid, idx, "context", expr, ft, "statements", exp, concepts,
             {"section": w[0], "proximity": w[1], "semantic": w[2]} if w else None)
            for pid, idx, expr, ft, exp, concepts, w in CONTEXT_PATTERNS]
    schema = ("pattern_id string, pattern_idx int, type string, expression string, feature_type string, "
              "industry string, expected_section string, semantic_concepts array<string>, "
              "context_weights map<string,double>")
    return prepare_patterns(spark.createDataFrame(rows, schema))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = attach_patterns(statements(spark, sf_dir), context_patterns(spark))
    return d.withColumn("context", context_column())


# ---------------------------------------------------------------------------
# oracle
# ---------------------------------------------------------------------------
_ROWS = [(pid, idx, "context", expr, ft, "statements") for pid, idx, expr, ft, *_ in CONTEXT_PATTERNS]
_DOCS_DUCK = ("SELECT o_orderkey AS doc_id, 'statements' AS industry, "
              f"{STATEMENT_TEXT} AS text FROM orders LEFT JOIN customer ON o_custkey = c_custkey")


def _ctx_values() -> str:
    rows = []
    for pid, _idx, _e, _ft, exp, concepts, w in CONTEXT_PATTERNS:
        ws, wp, wm = w if w else (0.4, 0.3, 0.3)
        hits = sum(1 for c in concepts if c in CONCEPTS)
        rows.append((pid, exp, float(ws), float(wp), float(wm), len(concepts), hits))
    return values_sql(rows, ["pattern_id", "expected", "ws", "wp", "wm", "n_concepts", "n_hits"])


_SECTIONS = f""",
markers AS ({values_sql([(i, m, t, lv) for i, (m, t, lv) in enumerate(MARKERS)], ['idx', 'marker', 'type', 'level'])}),
mk AS (SELECT d.doc_id, m.idx, m.marker, m.type, m.level, instr(d.text, m.marker) - 1 AS pos
       FROM docs d JOIN markers m ON instr(d.text, m.marker) > 0),
mk2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, -level, idx) AS rk FROM mk),
mk3 AS (SELECT a.*, coalesce((SELECT min(b.pos) FROM mk2 b WHERE b.doc_id = a.doc_id AND b.rk > a.rk
                               AND b.level <= a.level), 9223372036854775807) AS close FROM mk2 a),
secs AS (
  SELECT s.doc_id, s.pattern_id, s.st, s.en, s.mt, s.c,
         coalesce(list(m.type ORDER BY m.rk) FILTER (WHERE m.type IS NOT NULL), []) AS hierarchy,
         coalesce(arg_max(m.type, m.rk), '') AS cur_type, coalesce(arg_max(m.marker, m.rk), '') AS cur_marker,
         coalesce(arg_max(m.level, m.rk), 0) AS cur_level
  FROM scored s LEFT JOIN mk3 m ON m.doc_id = s.doc_id AND m.pos <= s.st AND s.st < m.close
  GROUP BY s.doc_id, s.pattern_id, s.st, s.en, s.mt, s.c)"""


@register("section_assignment", "WITH " + scored_matches_sql(_DOCS_DUCK, None, _ROWS).lstrip() + _SECTIONS + """
SELECT doc_id::BIGINT AS doc_id, pattern_id, st::BIGINT AS match_start,
       regexp_replace(cur_marker, '^\\s+|\\s+$', '', 'g') AS section,
       array_to_string(hierarchy, '>') AS hierarchy, cur_level::INT AS hierarchy_level
FROM secs""")
def section_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enclosing section stack of each base match (marker intervals per document)."""
    from ..operators.context import active_sections, located_markers
    from ..operators.matching import regex_matches
    d = _docs(spark, sf_dir)
    d = d.withColumn("patterns", F.transform("patterns", lambda p: p.withField("type", F.lit("regex"))))
    d = regex_matches(d).withColumn("_mk", located_markers(F.col("text"), F.col("context")))
    rows = d.select("doc_id", "_mk", F.explode("regex_matches").alias("m"))
    act = active_sections(F.col("_mk"), F.col("m.start"))
    rows = rows.withColumn("act", act)
    cur = F.try_element_at(F.col("act"), F.lit(-1))
    return rows.select(F.col("doc_id").cast("bigint"), F.col("m.pattern_id").alias("pattern_id"),
                       F.col("m.start").cast("bigint").alias("match_start"),
                       F.coalesce(F.regexp_replace(cur["marker"], r"(?U)^\s+|\s+$", ""), F.lit("")).alias("section"),
                       F.array_join(F.transform("act", lambda s: s["type"]), ">").alias("hierarchy"),
                       F.coalesce(cur["level"], F.lit(0)).cast("int").alias("hierarchy_level"))


def _nearby_sql() -> str:
    terms = []
    for t, w in NEARBY:
        pos = f"(instr(d.text, {sql_str(t)}) - 1)"
        terms.append((f"CASE WHEN instr(d.text, {sql_str(t)}) > 0 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - "
                      f"least(abs({pos} - x.st), abs({pos} - x.en))::DOUBLE / 1000) * {w!r}::DOUBLE ELSE 0.0::DOUBLE END",
                      f"CASE WHEN instr(d.text, {sql_str(t)}) > 0 THEN {w!r}::DOUBLE ELSE 0.0::DOUBLE END"))
    s = " + ".join(a for a, _ in terms)
    w = " + ".join(b for _, b in terms)
    return f"CASE WHEN ({w}) > 0 THEN ({s}) / ({w}) ELSE 0.5::DOUBLE END"


@register("context_confidence", "WITH " + scored_matches_sql(_DOCS_DUCK, None, _ROWS).lstrip() + _SECTIONS + f""",
cp AS ({_ctx_values()}),
sc AS (
  SELECT x.*, cp.*,
    CASE WHEN cp.expected IS NULL OR cp.expected = '' THEN 0.5
         WHEN x.cur_type = cp.expected THEN 1.0
         WHEN list_contains(x.hierarchy, cp.expected)
              THEN greatest(0.4, 1.0 - (len(x.hierarchy) - (list_position(x.hierarchy, cp.expected) - 1)) * 0.2)
         WHEN len(list_filter(list_prepend(x.cur_type, x.hierarchy), lambda s:
                  starts_with(cp.expected, s || '_') OR starts_with(s, cp.expected || '_'))) > 0 THEN 0.8
         WHEN contains(cp.expected, x.cur_type) OR contains(x.cur_type, cp.expected) THEN 0.6
         WHEN x.cur_type <> '' THEN 0.3 ELSE 0.1 END::DOUBLE AS sec,
    {_nearby_sql()} AS prox,
    CASE WHEN cp.n_concepts = 0 THEN 0.5 WHEN cp.n_hits = 0 THEN 0.3
         ELSE 0.3 + 0.7 * (cp.n_hits::DOUBLE / cp.n_concepts) END::DOUBLE AS sem
  FROM secs x JOIN cp ON x.pattern_id = cp.pattern_id JOIN docs d ON d.doc_id = x.doc_id),
cw AS (SELECT *, CASE WHEN sec > 0.8 THEN ws * 1.5 WHEN sec < 0.4 THEN ws * 0.6 ELSE ws END AS ws2,
              CASE WHEN prox > 0.8 THEN least(1.0::DOUBLE, prox * 1.2) ELSE prox END AS prox2,
              CASE WHEN sem > 0.7 THEN least(1.0::DOUBLE, sem * 1.15) ELSE sem END AS sem2 FROM sc),
cc AS (SELECT *, sec * (ws2 / (ws2 + wp + wm)) + prox2 * (wp / (ws2 + wp + wm)) + sem2 * (wm / (ws2 + wp + wm)) AS c0 FROM cw),
cf AS (SELECT *, CASE WHEN sec > 0.9 AND prox2 > 0.8 THEN least(1.0::DOUBLE, c0 * 1.2)
                      WHEN sec < 0.3 THEN c0 * 0.7 ELSE c0 END AS ctx_conf FROM cc)
SELECT doc_id::BIGINT AS doc_id, pattern_id, mt AS match_text, st::BIGINT AS match_start,
       CASE WHEN list_contains(hierarchy, expected) THEN expected ELSE cur_type END AS section_type,
       round(c * 0.6 + ctx_conf * 0.4, 6) AS confidence
FROM cf WHERE c * 0.6 + ctx_conf * 0.4 >= 0.6""")
def context_confidence_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context matches: base regex confidence blended with section, proximity and semantic scores."""
    d = context_matches(_docs(spark, sf_dir))
    return (d.select("doc_id", F.explode("context_matches").alias("m"))
             .select(F.col("doc_id").cast("bigint"), F.col("m.pattern_id").alias("pattern_id"),
                     F.col("m.text").alias("match_text"), F.col("m.start").cast("bigint").alias("match_start"),
                     F.col("m.section_type").alias("section_type"), r6("m.confidence").alias("confidence")))


@register("context_resolved_matches")
def context_resolved_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_matches with a context: context matches joined with resolution."""
    d = find_matches(_docs(spark, sf_dir), context_col="context", fuzzy=False)
    return (d.select("doc_id", F.explode("matches").alias("m"))
             .select(F.col("doc_id").cast("bigint"), F.col("m.pattern_id").alias("pattern_id"),
                     F.col("m.text").alias("match_text"), F.col("m.start").cast("bigint").alias("match_start"),
                     F.col("m.section").alias("section"), r6("m.confidence").alias("confidence")))


assert all(re.compile(e) for _, _, e, *_ in CONTEXT_PATTERNS)
