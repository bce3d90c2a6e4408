"""Learner queries over feature sightings rendered from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.learning import (candidate_stats, gate_sightings, learn_patterns,
                                  stale_candidates)
from ..sources.configs import delete_with_cascade, newest_first, upsert_latest
from ..sources.fixed_values import PREDEFINED_FEATURE_REGEX
from ..sources.render import SIGHTINGS_DUCK, sightings
from ..sources.tables import table
from .registry import r6, register, sql_str

_PRE = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in PREDEFINED_FEATURE_REGEX.items())

#: The sightings that pass F6 and F7.
GATED_SQL = f"""
WITH s0 AS ({SIGHTINGS_DUCK}),
s AS (
  SELECT * FROM s0
  WHERE confidence >= 0.8 AND text IS NOT NULL AND length(text) >= 3
    AND (CASE feature_type {_PRE} END IS NULL OR regexp_matches(text, CASE feature_type {_PRE} END)))"""

_STATS = GATED_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY feature_type, text ORDER BY ts, seq) AS i,
             count(*) OVER (PARTITION BY feature_type, text) AS n FROM s),
stats AS (
  SELECT feature_type, text, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen,
         sum(confidence * CASE WHEN i = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - i) END) AS confidence
  FROM r GROUP BY feature_type, text)"""


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_stats(gate_sightings(sightings(spark, sf_dir)))


@register("candidate_ema", _STATS + """
SELECT feature_type, text, occurrences::BIGINT AS occurrences, first_seen, last_seen,
       round(confidence, 6) AS confidence FROM stats""")
def candidate_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate statistics: occurrences, first/last seen, EMA confidence in arrival order."""
    s = _stats(spark, sf_dir)
    return s.select("feature_type", "text", F.col("occurrences").cast("bigint"), "first_seen",
                    "last_seen", r6("confidence").alias("confidence"))


_ESC = "regexp_replace(text, '([()\\[\\]{}?*+\\-|^$\\\\.&~# \\t\\n\\r\\x0b\\x0c])', '\\\\\\1', 'g')"


def expression_sql() -> str:
    """The pattern of a sighting's type and text: the predefined one, else the literal text."""
    return (f"CASE WHEN CASE feature_type {_PRE} END IS NOT NULL THEN "
            f"CASE WHEN regexp_matches(text, CASE feature_type {_PRE} END) THEN CASE feature_type {_PRE} END END "
            f"WHEN length('^' || {_ESC} || '$') BETWEEN 3 AND 200 THEN '^' || {_ESC} || '$' END")


@register("learned_patterns", _STATS + f""",
mature AS (SELECT * FROM stats WHERE occurrences >= 3 AND round(confidence, 9) >= 0.8),
gen AS (
  SELECT *, {expression_sql()} AS expression
  FROM mature)
SELECT 'general' AS industry, feature_type, expression, count(*)::BIGINT AS n_candidates,
       sum(occurrences)::BIGINT AS n_sightings, sum(floor(occurrences / 3))::BIGINT AS n_emissions
FROM gen WHERE expression IS NOT NULL GROUP BY feature_type, expression""")
def learned_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mature candidates (>= 3 sightings, EMA >= 0.8) -> generated and validated patterns, deduplicated."""
    p = learn_patterns(_stats(spark, sf_dir))
    return p.select("industry", "feature_type", "expression", F.col("n_candidates").cast("bigint"),
                    F.col("n_sightings").cast("bigint"), F.col("n_emissions").cast("bigint"))


@register("stale_candidates", _STATS + """
SELECT feature_type, text, last_seen,
       floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_seen)) / 86400000000)::BIGINT AS age_days,
       floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_seen)) / 86400000000) > 30 AS stale
FROM stats""")
def stale_candidates_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates not seen for more than 30 whole days before the newest event."""
    newest = table(spark, sf_dir, "events", "ts").agg(F.max("ts").alias("_now"))   # one row, in the same plan
    out = stale_candidates(_stats(spark, sf_dir).crossJoin(F.broadcast(newest)), F.col("_now"))
    return out.select("feature_type", "text", "last_seen", "age_days", "stale")


@register("latest_patterns", """
SELECT event_type AS feature_type, json_extract_string(props, '$.k') AS key,
       arg_max(event_id, (ts, event_id))::BIGINT AS version_id, arg_max(value, (ts, event_id)) AS value,
       count(*)::BIGINT AS n_versions
FROM events GROUP BY event_type, json_extract_string(props, '$.k')""")
def latest_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last version wins per key (events as successive versions of a keyed entry)."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value", "props")
    ev = ev.select(F.col("event_type").alias("feature_type"),
                   F.get_json_object("props", "$.k").alias("key"), "event_id", "ts", "value")
    latest = upsert_latest(ev, ["feature_type", "key"], order_cols=["ts", "event_id"])
    return latest.select("feature_type", "key", F.col("event_id").cast("bigint").alias("version_id"),
                         "value", F.col("n_versions").cast("bigint"))


_VERSIONS = """
SELECT event_type AS feature_type, json_extract_string(props, '$.k') AS key, event_id, ts FROM events"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events", "event_id", "ts", "event_type", "props")
            .select(F.col("event_type").alias("feature_type"), F.get_json_object("props", "$.k").alias("key"),
                    F.col("event_id").cast("bigint").alias("event_id"), "ts"))


@register("pattern_history", f"""
SELECT *, row_number() OVER (PARTITION BY feature_type, key ORDER BY ts DESC, event_id DESC)::BIGINT AS seq
FROM ({_VERSIONS})""")
def pattern_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored version of a pattern, numbered newest first."""
    return newest_first(_versions(spark, sf_dir), ["feature_type", "key"], ["ts", "event_id"])


@register("pattern_delete_cascade", f"""
WITH v AS ({_VERSIONS}), gone AS (SELECT DISTINCT key FROM v WHERE event_id % 997 = 0)
SELECT feature_type, key, event_id FROM v WHERE key IS NULL OR key NOT IN (SELECT key FROM gone WHERE key IS NOT NULL)""")
def pattern_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns deleted by key, and every version of them with them."""
    v = _versions(spark, sf_dir)
    gone = v.filter("event_id % 997 = 0 AND key IS NOT NULL").select("key").distinct()
    _, (versions,) = delete_with_cascade(v.select("key").distinct(), [v], gone, "key")
    return versions.select("feature_type", "key", "event_id")
