"""Queries of the pattern store, prompt reuse and the SQL surface."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import register_functions, register_matcher
from ..operators.matching import prepare_patterns
from ..operators.prompts import replies_for
from ..session import checkpoint_dir, save_table
from ..sources.store import append_counts, count_totals, delete_patterns, read_store, upsert_patterns
from ..sources.tables import DOCUMENTS_PER_TASK, spread, table
from .document_queries import _MIXED, MIXED_ROWS, PATTERN_SCHEMA
from .registry import r6, register

BATCHES = 3


@register("pattern_store_cycle", f"""
WITH v AS (SELECT event_type || ':' || coalesce(json_extract_string(props, '$.k'), '') AS pattern_id, event_id, ts, value FROM events),
gone AS (SELECT DISTINCT pattern_id FROM v WHERE event_id % 499 = 0)
SELECT pattern_id, arg_max(event_id, (event_id % {BATCHES}, ts, event_id))::BIGINT AS version_id,
       count(*)::BIGINT AS n_true, (count(*) FILTER (WHERE value > 50))::BIGINT AS n_false
FROM v WHERE pattern_id NOT IN (SELECT pattern_id FROM gone) GROUP BY pattern_id""")
def pattern_store_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of events as pattern versions: upserts and validation counts, one batch applied
    twice, then deletions (S12, S14)."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value", "props")
    key = F.concat("event_type", F.lit(":"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")))
    ev = ev.select(key.alias("pattern_id"), F.col("event_id").cast("bigint").alias("event_id"), "ts", "value")
    run = f"{checkpoint_dir(spark).rstrip('/')}/docsift-store/{uuid.uuid4().hex}"
    for i in (0, 1, 1, 2):
        batch = ev.filter(F.col("event_id") % BATCHES == i)
        upsert_patterns(batch.select("pattern_id", "event_id", "ts"), f"{run}/patterns", ["ts", "event_id"])
        append_counts(batch.groupBy("pattern_id").agg(F.count("*").alias("n_true"), F.count_if(F.col("value") > 50).alias("n_false")),
                      f"{run}/counts", i)
    delete_patterns(ev.filter("event_id % 499 = 0"), f"{run}/patterns")
    stored = read_store(spark, f"{run}/patterns").select("pattern_id", F.col("event_id").alias("version_id"))
    return stored.join(count_totals(spark, f"{run}/counts"), "pattern_id").select("pattern_id", "version_id", "n_true", "n_false")


@register("prompt_replies", """
WITH p AS (SELECT o_orderkey, 'Rate ' || o_orderpriority || ' on ' || CAST(o_orderdate AS DATE) AS prompt FROM orders),
memo AS (SELECT prompt, max(o_orderkey) AS k FROM p WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0 GROUP BY prompt)
SELECT p.o_orderkey::BIGINT AS o_orderkey, p.prompt,
       CASE WHEN m.k IS NULL THEN 'made: ' || upper(p.prompt) ELSE 'kept: ' || m.k END AS reply, m.k IS NOT NULL AS reused
FROM p LEFT JOIN memo m ON p.prompt = m.prompt""")
def prompt_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies by prompt: unexpired ones are reused (the latest), each other prompt is answered once."""
    p = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderdate").select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        F.concat(F.lit("Rate "), "o_orderpriority", F.lit(" on "), F.col("o_orderdate").cast("date").cast("string")).alias("prompt"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    expires = F.when(F.col("o_orderkey") % 3 == 0, now).otherwise(now + F.make_interval(secs=F.col("o_orderkey")))
    memo = p.filter("o_orderkey % 5 = 0").select(F.sha2("prompt", 256).alias("prompt_hash"),
                                                 F.concat(F.lit("kept: "), F.col("o_orderkey")).alias("reply"),
                                                 expires.alias("expires_at"))
    out, _ = replies_for(p, memo, lambda d: d.withColumn("reply", F.concat(F.lit("made: "), F.upper("prompt"))), now, 3600)
    return out.select("o_orderkey", "prompt", "reply", "reused")


@register("sql_find_matches", _MIXED + """
SELECT doc_id::BIGINT AS doc_id, pattern_id, feature_type, mt AS match_text, st::BIGINT AS match_start,
       en::BIGINT AS match_end, round(c, 6) AS confidence FROM scored""")
def sql_find_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matcher as a table function in SQL, over whole documents."""
    register_matcher(spark, prepare_patterns(spark.createDataFrame(MIXED_ROWS, PATTERN_SCHEMA)))
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    docs = spread(docs, docs.count(), DOCUMENTS_PER_TASK)
    found = spark.sql("SELECT d.doc_id, m.* FROM {docs} d, LATERAL find_matches(d.text, 'contact') m", docs=docs)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "pattern_id", "feature_type", "match_text",
                        "match_start", "match_end", r6("confidence").alias("confidence"))


@register("sql_scorers")
def sql_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text scorers called from SQL, on the names of parts that follow each other."""
    register_functions(spark)
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    pairs = spark.sql("""
        SELECT CAST(a.p_partkey AS BIGINT) AS p_partkey, a.p_name AS n1, b.p_name AS n2
        FROM {p} a JOIN {p} b ON b.p_partkey = a.p_partkey + 1""", p=p)
    return spark.sql("""
        SELECT p_partkey, n1, n2, round(seq_ratio(n1, n2), 6) AS ratio, round(levenshtein_ratio(n1, n2), 6) AS lev_ratio,
               round(phonetic_similarity(n1, n2), 6) AS phonetic, word_soundex(n1) AS soundex, word_metaphone(n1) AS metaphone
        FROM {pairs}""", pairs=spread(pairs, p.count()))
