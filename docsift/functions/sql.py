"""Scorers and the matcher for SQL users.

``register_functions`` gives SQL the text scorers; ``register_matcher`` gives it a table
function over a set of patterns:

    SELECT d.doc_id, m.* FROM documents d, LATERAL find_matches(d.text, d.industry) m
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.matching import BROADCAST_PATTERNS, match_facts, match_score
from ..sources.fixed_values import MIN_MATCH_CONFIDENCE
from .similarity import metaphone_py, phonetic_similarity, seq_ratio, soundex_py

MATCHES = ("pattern_id string, feature_type string, match_text string, match_start bigint, "
           "match_end bigint, confidence double")


@F.pandas_udf(T.StringType())
def _soundex(word: pd.Series) -> pd.Series:
    return word.map(soundex_py, na_action="ignore")


@F.pandas_udf(T.StringType())
def _metaphone(word: pd.Series) -> pd.Series:
    return word.map(metaphone_py, na_action="ignore")


def register_functions(spark: SparkSession) -> None:
    """SQL names of the scorers; all give null for a null argument.

    ``seq_ratio(a, b)``, ``phonetic_similarity(a, b)``, ``word_soundex(a)`` and ``word_metaphone(a)``
    run in Arrow batches; ``levenshtein_ratio(a, b)`` is inlined into the query's plan."""
    for name, fn in (("seq_ratio", seq_ratio), ("phonetic_similarity", phonetic_similarity),
                     ("word_soundex", _soundex), ("word_metaphone", _metaphone)):
        spark.udf.register(name, fn)
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION levenshtein_ratio(a STRING, b STRING) RETURNS DOUBLE
                 RETURN CASE WHEN greatest(length(a), length(b)) > 0
                             THEN 1 - levenshtein(a, b) / greatest(length(a), length(b)) END""")


def register_matcher(spark: SparkSession, patterns: DataFrame, name: str = "find_matches",
                     min_confidence: float = MIN_MATCH_CONFIDENCE, most: int = BROADCAST_PATTERNS) -> None:
    """The table function ``name(text, industry)``: matches of the industry's regex and learned
    patterns that aren't blank and reach ``min_confidence`` (H1-H3, F2, F3).

    ``patterns``: prepared pattern rows, at most ``most`` of them, since every worker holds them
    all; more are an error (join them with ``attach_patterns`` instead).  A null text, and an
    industry that is null or has no patterns, give no rows."""
    rows = (patterns.filter(F.col("is_valid") & F.col("type").isin("regex", "learned") & F.col("industry").isNotNull())
            .select("industry", "pattern_idx", "pattern_id", "feature_type", "expression", "n_groups",
                    "confidence_value", "allow_inefficient").limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"{name}: over {most} patterns; use attach_patterns")
    held: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r.pattern_idx, r.pattern_id)):
        held.setdefault(r.industry, []).append(r.asDict())

    class FindMatches:
        def eval(self, text: str, industry: str):
            for p in held.get(industry, ()) if text is not None else ():
                for facts in match_facts(p["expression"], text):
                    c = match_score(p["confidence_value"], p["n_groups"], p["allow_inefficient"], facts)
                    if c >= min_confidence:
                        yield p["pattern_id"], p["feature_type"], facts[0], facts[1], facts[2], c

    spark.udtf.register(name, F.udtf(FindMatches, returnType=MATCHES))
