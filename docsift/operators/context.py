"""Context-aware matching.

A context is a per-document (or per-batch) struct:

    context STRUCT<
      section_markers: ARRAY<STRUCT<marker STRING, type STRING, level INT>>,   -- in declaration order
      nearby_features: ARRAY<STRUCT<text STRING, importance DOUBLE>>,           -- null = not given
      concepts:        ARRAY<STRING>>                                            -- null = not given

Per document the markers are located once (first occurrence; a literal ``\\n``
in a marker means a newline) and sorted by (position, -level, declaration);
the sections enclosing a position are the markers at or before it that no
later marker of the same or a higher rank (level <= own) has closed.
Everything is computed inside the document row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import let
from ..sources.fixed_values import DEFAULT_CONTEXT_WEIGHTS, MIN_MATCH_CONFIDENCE
from .matching import score_regex_match, with_scan


def located_markers(text: Column, ctx: Column) -> Column:
    """Markers found in the text, sorted by (pos, -level, declaration order)."""
    found = F.transform(ctx["section_markers"], lambda m, i: F.struct(
        (F.instr(text, F.replace(m["marker"], F.lit("\\n"), F.lit("\n"))) - 1).cast("bigint").alias("pos"),
        m["level"].alias("level"), i.alias("idx"),
        F.replace(m["marker"], F.lit("\\n"), F.lit("\n")).alias("marker"), m["type"].alias("type")))
    found = F.filter(found, lambda x: x["pos"] >= 0)
    return F.array_sort(found, lambda a, b: (
        F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1)
        .when(a["level"] > b["level"], -1).when(a["level"] < b["level"], 1)
        .when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1).otherwise(0)))


def active_sections(markers: Column, position: Column) -> Column:
    """The stack of sections enclosing ``position`` (general -> specific)."""
    before = F.filter(markers, lambda m: m["pos"] <= position)
    return F.aggregate(before, F.slice(before, 1, 0),
                       lambda acc, m: F.concat(F.filter(acc, lambda s: s["level"] < m["level"]), F.array(m)))


def section_score(expected: Column, current: Column, hierarchy: Column) -> Column:
    """H22.  An empty current section is a substring of anything (kept as is)."""
    depth = F.size(hierarchy) - (F.array_position(hierarchy, expected) - 1)
    related = F.exists(F.concat(F.array(current), hierarchy),
                       lambda s: expected.startswith(F.concat(s, F.lit("_")))
                       | s.startswith(F.concat(expected, F.lit("_"))))
    return (F.when(expected.isNull() | (expected == ""), F.lit(0.5))
            .when(current == expected, F.lit(1.0))
            .when(F.array_contains(hierarchy, expected), F.greatest(F.lit(0.4), 1.0 - depth * 0.2))
            .when(related, F.lit(0.8))
            .when(expected.contains(current) | current.contains(expected), F.lit(0.6))
            .when(current != "", F.lit(0.3))
            .otherwise(F.lit(0.1)))


def proximity_score(text: Column, ctx: Column, start: Column, end: Column) -> Column:
    """H23 + A12: importance-weighted distance decay to the first occurrence of each feature."""
    feats = F.transform(ctx["nearby_features"], lambda f: F.struct(
        (F.instr(text, f["text"]) - 1).alias("pos"), F.coalesce(f["importance"], F.lit(1.0)).alias("w")))
    found = F.filter(feats, lambda f: f["pos"] >= 0)
    acc = F.aggregate(found, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")),
                      lambda a, f: F.struct(
                          (a["s"] + F.greatest(F.lit(0.0), 1.0 - F.least(F.abs(f["pos"] - start),
                                                                        F.abs(f["pos"] - end)) / 1000) * f["w"]).alias("s"),
                          (a["w"] + f["w"]).alias("w")))
    return F.when(ctx["nearby_features"].isNull(), F.lit(0.5)).otherwise(
        let(acc, lambda a: F.when(a["w"] > 0, a["s"] / a["w"]).otherwise(F.lit(0.5))))


def semantic_score(ctx: Column, expected: Column) -> Column:
    """H24 + J14: share of expected concepts present (duplicates in ``expected`` count)."""
    hits = F.size(F.filter(expected, lambda c: F.array_contains(ctx["concepts"], c)))
    return (F.when(ctx["concepts"].isNull(), F.lit(0.5))
            .when(expected.isNull() | (F.size(expected) == 0), F.lit(0.5))
            .when(hits == 0, F.lit(0.3))
            .otherwise(0.3 + 0.7 * (hits / F.size(expected))))


def context_confidence(sec: Column, prox: Column, sem: Column, weights: Column) -> Column:
    """H25 with immutable weights (the pattern's weights are not changed between matches)."""
    ws = F.coalesce(weights["section"], F.lit(DEFAULT_CONTEXT_WEIGHTS["section"]))
    wp = F.coalesce(weights["proximity"], F.lit(DEFAULT_CONTEXT_WEIGHTS["proximity"]))
    wm = F.coalesce(weights["semantic"], F.lit(DEFAULT_CONTEXT_WEIGHTS["semantic"]))
    ws = F.when(sec > 0.8, ws * 1.5).when(sec < 0.4, ws * 0.6).otherwise(ws)
    prox = F.when(prox > 0.8, F.least(F.lit(1.0), prox * 1.2)).otherwise(prox)
    sem = F.when(sem > 0.7, F.least(F.lit(1.0), sem * 1.15)).otherwise(sem)
    total = ws + wp + wm
    conf = sec * (ws / total) + prox * (wp / total) + sem * (wm / total)
    return (F.when((sec > 0.9) & (prox > 0.8), F.least(F.lit(1.0), conf * 1.2))
            .when(sec < 0.3, conf * 0.7).otherwise(conf))


def _context_match(m: Column, p: Column, text: Column, ctx: Column, markers: Column) -> Column:
    act = active_sections(markers, m["start"])
    return let(act, lambda a: _finish(m, p, text, ctx, a))


def _finish(m: Column, p: Column, text: Column, ctx: Column, act: Column) -> Column:
    cur = F.try_element_at(act, F.lit(-1))
    cur_type = F.coalesce(cur["type"], F.lit(""))
    hierarchy = F.transform(act, lambda s: s["type"])
    expected = p["expected_section"]
    scores = F.struct(
        section_score(expected, cur_type, hierarchy).alias("sec"),
        proximity_score(text, ctx, m["start"], m["end"]).alias("prox"),
        semantic_score(ctx, p["semantic_concepts"]).alias("sem"))

    def final(s):
        c = context_confidence(s["sec"], s["prox"], s["sem"], p["context_weights"])
        reported = F.when(F.array_contains(hierarchy, expected), expected).otherwise(cur_type)
        return (m.withField("confidence", m["confidence"] * 0.6 + c * 0.4)
                 .withField("match_type", F.lit("context"))
                 .withField("section", F.coalesce(F.regexp_replace(cur["marker"], r"(?U)^\s+|\s+$", ""), F.lit("")))
                 .withField("section_type", reported)
                 .withField("hierarchy_level", F.coalesce(cur["level"], F.lit(0))))
    return let(scores, final)


def context_matches(df: DataFrame, text_col: str = "text", patterns_col: str = "patterns",
                    context_col: str = "context", min_confidence: float = MIN_MATCH_CONFIDENCE,
                    out_col: str = "context_matches") -> DataFrame:
    """Regex base matches of context patterns re-scored with their context.
    Only rows with a non-null context get context matches (as the matcher requires)."""
    df = with_scan(df, text_col, patterns_col, ("context",), min_confidence, "_scan")
    text, ctx = F.col(text_col), F.col(context_col)
    df = df.withColumn("_markers", located_markers(text, ctx))
    pattern = lambda x: F.get(F.col(patterns_col), x["at"])
    base = F.filter(F.transform("_scan", lambda r: F.struct(r["at"].alias("at"), score_regex_match(r, pattern(r)).alias("m"))),
                    lambda b: b["m"]["confidence"] >= min_confidence)
    out = F.transform(base, lambda b: _context_match(b["m"], pattern(b), text, ctx, F.col("_markers")))
    out = F.filter(out, lambda m: m["confidence"] >= min_confidence)
    return (df.withColumn(out_col, F.when(ctx.isNull(), F.array().cast(
        "array<struct<pattern_id:string,pattern_idx:int,feature_type:string,match_type:string,text:string,"
        "start:bigint,end:bigint,confidence:double,named_groups:map<string,string>,section:string,"
        "section_type:string,hierarchy_level:int>>")).otherwise(out))
              .drop("_scan", "_markers"))


def in_expected_section(markers: Column, position: Column, expected: Column) -> Column:
    """Expected section is the current type or in the hierarchy (no expectation -> true)."""
    act = active_sections(markers, position)
    return expected.isNull() | F.array_contains(F.transform(act, lambda s: s["type"]), expected)
