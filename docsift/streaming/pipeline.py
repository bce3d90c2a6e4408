"""Structured Streaming jobs.

``process_stream`` (R1, R2, R4, R5, S15): documents arrive on a file (or any)
stream; each micro-batch is handled in ``foreachBatch``:

    hash contents (H52) -> drop in-batch repeats -> anti-join the results table
    (J11: contents already processed are reused, not recomputed) -> match and
    score the new contents -> append them to the results table under the
    batch id (a replayed batch overwrites its own output: idempotent) and
    record every document's content hash in the document map; the features of
    the new contents are a second table, written under the batch id as well.

The result table is the durable cache: it lives in the shared folder and is
read back by hash, so no unbounded in-memory streaming state is kept.

``learner_stream`` (R3, H49, H50): sightings grouped by (feature_type, text) go
through ``transformWithStateInPandas``; the value state is the candidate (count,
EMA, first and last seen) folded in arrival order; a candidate that matures emits
its learned pattern and restarts.  The state has a time to live: a candidate that
is idle for 30 days goes from the store without being seen again.  One whose next
sighting is over 30 days later by its own time stamp restarts too, so that a
replay of old sightings gives what the live stream gave.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.documents import content_hash, unexpired
from ..operators.features import dedup_by_key, pattern_features
from ..operators.learning import generate_expression
from ..operators.matching import attach_patterns, find_matches, pattern_confidence
from ..session import checkpoint_dir
from ..sources.fixed_values import TTL_TASK_RESULT

RESULT_COLS = ["content_hash", "industry", "source_doc_id", "features", "pattern_count", "pattern_confidence",
               "status", "error", "batch_id", "processed_at", "expires_at"]


FEATURE = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("confidence", T.DoubleType())])


def results_schema() -> T.StructType:
    return T.StructType([
        T.StructField("content_hash", T.StringType()), T.StructField("industry", T.StringType()),
        T.StructField("source_doc_id", T.LongType()), T.StructField("features", T.ArrayType(FEATURE)),
        T.StructField("pattern_count", T.LongType()), T.StructField("pattern_confidence", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()), T.StructField("batch_id", T.LongType()),
        T.StructField("processed_at", T.TimestampType()), T.StructField("expires_at", T.TimestampType())])


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table so far; empty only if its folder doesn't exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def process_batch(batch: DataFrame, batch_id: int, patterns: DataFrame, out_dir: str,
                  ttl_seconds: int = TTL_TASK_RESULT, industry: str | None = None) -> None:
    """One micro-batch of R1 (also usable on a static DataFrame).

    A document's own ``industry`` decides its patterns; ``industry`` is that of a stream whose
    documents have none.  Contents with a result that hasn't expired are not processed again
    (J11); a blank or missing text fails (F8)."""
    spark = batch.sparkSession
    own = F.col("industry") if "industry" in batch.columns else F.lit(None).cast("string")
    docs = batch.select("doc_id", "text", F.coalesce(own, F.lit(industry)).alias("industry"),
                        content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))
    # every document's hash (document map), written per batch id -> replay-safe
    (docs.select("doc_id", "content_hash", "industry", F.lit(batch_id).cast("bigint").alias("batch_id"))
         .write.mode("overwrite").parquet(f"{out_dir}/doc_map/batch_id={batch_id}"))
    results = _read_or_empty(spark, f"{out_dir}/results", results_schema())
    done = (results.filter((F.col("batch_id") != batch_id) & unexpired(F.col("expires_at"), F.current_timestamp()))
            .select(F.col("content_hash").alias("d_hash"), F.col("industry").alias("d_industry")).distinct())
    fresh = (docs.groupBy("content_hash", "industry")
             .agg(F.min_by(F.struct("doc_id", "text"), F.col("doc_id")).alias("d"))
             # results of all earlier batches: dealt by hash, never sent to the driver to be broadcast
             .join(done.hint("merge"), (F.col("content_hash") == F.col("d_hash")) & F.col("industry").eqNullSafe(F.col("d_industry")), "left_anti")
             .select("content_hash", "industry", "d.*"))
    fuzzy = not patterns.filter("type = 'fuzzy'").isEmpty()
    scored = pattern_confidence(find_matches(attach_patterns(fresh, patterns), fuzzy=fuzzy))
    scored = scored.withColumn("_found", pattern_features(F.col("matches"))).withColumn("features", dedup_by_key(F.col("_found")))
    error = F.when(F.col("text").isNull() | ~F.col("text").rlike(r"(?U)\S"), F.lit("No content provided"))
    res = scored.select("content_hash", "industry", F.col("doc_id").alias("source_doc_id"), "features", "pattern_count",
                        "pattern_confidence", F.when(error.isNull(), F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
                        error.alias("error"), F.lit(batch_id).cast("bigint").alias("batch_id"),
                        F.current_timestamp().alias("processed_at"),
                        (F.current_timestamp() + F.expr(f"INTERVAL {int(ttl_seconds)} SECONDS")).alias("expires_at"))
    res.write.mode("overwrite").parquet(f"{out_dir}/results/batch_id={batch_id}")
    # The second output, from the rows just written, so that nothing is matched twice
    made = spark.read.schema(res.schema).parquet(f"{out_dir}/results/batch_id={batch_id}")
    (made.select("content_hash", "industry", F.posexplode("features").alias("pos", "f"))
         .select("content_hash", "industry", (F.col("pos") + 1).cast("bigint").alias("seq"), "f.*")
         .write.mode("overwrite").parquet(f"{out_dir}/features/batch_id={batch_id}"))


def current_results(results: DataFrame) -> DataFrame:
    """The newest result of each content and industry: one that expired was made again."""
    rest = [c for c in results.columns if c not in ("content_hash", "industry")]
    return (results.groupBy("content_hash", "industry")
            .agg(F.max_by(F.struct(*rest), F.struct("processed_at", "batch_id")).alias("r"))
            .select("content_hash", "industry", "r.*"))


def process_stream(stream: DataFrame, patterns: DataFrame, out_dir: str,
                   checkpoint: str, available_now: bool = True, industry: str | None = None):
    """Start R1 on a streaming DataFrame (doc_id, text); returns the StreamingQuery."""
    writer = (stream.writeStream
              .foreachBatch(lambda b, i: process_batch(b, i, patterns, out_dir, industry=industry))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def task_status(results: DataFrame, now=None) -> DataFrame:
    """Processing / completed / failed / expired."""
    now_c = F.current_timestamp() if now is None else F.lit(now)
    return results.withColumn("task_status", F.when(F.col("error").isNotNull(), "failed")
                              .when(F.col("expires_at") < now_c, "expired")
                              .when(F.col("status") == "completed", "completed").otherwise("processing"))


def clear_cache(entries: DataFrame, key_col: str, prefix: str | None = None) -> DataFrame:
    """Keep entries whose key does not start with ``prefix`` (all cleared when None)."""
    if prefix is None:
        return entries.limit(0)
    return entries.filter(~F.col(key_col).startswith(prefix))


# ---------------------------------------------------------------------------
# Streaming learner
# ---------------------------------------------------------------------------
LEARNED_SCHEMA = T.StructType([
    T.StructField("feature_type", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("expression", T.StringType()), T.StructField("occurrences", T.LongType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("first_us", T.LongType()),
    T.StructField("last_us", T.LongType())])
#: Times in microseconds.
STATE_SCHEMA = T.StructType([
    T.StructField("occurrences", T.LongType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType())])
STALE_DAYS = 30
DAY_US = 86_400_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CandidateLearner(StatefulProcessor):
    """One candidate of the learner.  Of a micro-batch's sightings of a key it holds three numbers
    each (24 bytes), to put them in order; the source's ``maxBytesPerTrigger`` bounds these."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.candidate = handle.getValueState("candidate", STATE_SCHEMA, self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        us, seq, confidence, expression = [], [], [], None
        for pdf in rows:
            us.append(pdf["us"].to_numpy(np.int64))
            seq.append(pdf["seq"].to_numpy(np.int64))
            confidence.append(pdf["confidence"].to_numpy(float))
            expression = pdf["expression"].iloc[0] if len(pdf) else expression
        us, seq, confidence = np.concatenate(us), np.concatenate(seq), np.concatenate(confidence)
        order = np.lexsort((seq, us))
        count, ema, first, last = self.candidate.get() if self.candidate.exists() else (0, 0.0, 0, 0)
        out = []
        for t, x in zip(us[order].tolist(), confidence[order].tolist()):
            if count and (t - last) // DAY_US > STALE_DAYS:  # H50: the idle candidate was dropped
                count = 0
            if count:
                count, ema, last = count + 1, ema * 0.7 + x * 0.3, t
            else:
                count, ema, first, last = 1, x, t, t
            # the batch learner's rule: maturity is judged at 9 decimals
            if count >= 3 and round(ema, 9) >= 0.8 and expression is not None:
                out.append((*key, expression, count, ema, first, last))
                count = 0
        if count:
            self.candidate.update((count, ema, first, last))
        else:
            self.candidate.clear()
        yield pd.DataFrame(out, columns=[f.name for f in LEARNED_SCHEMA.fields])

    def close(self) -> None:
        pass


def learner_stream(sightings: DataFrame, idle_seconds: int = STALE_DAYS * 86400) -> DataFrame:
    """R3 on a streaming DataFrame of gated sightings.  The pattern that a candidate would
    give is a column (H46-H48, as in batch); a candidate without one never matures."""
    keyed = (sightings.withColumn("expression", generate_expression(F.col("feature_type"), F.col("text")))
             .select("feature_type", "text", "expression", "confidence", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")))
    learned = (keyed.groupBy("feature_type", "text")
               .transformWithStateInPandas(CandidateLearner(idle_seconds * 1000), LEARNED_SCHEMA, "Append", "ProcessingTime"))
    return learned.select("feature_type", "text", "expression", "occurrences", "confidence",
                          F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"))


def run_available_now(df: DataFrame, name: str, spark: SparkSession, run: str | None = None) -> DataFrame:
    """Drive a streaming DataFrame to completion into a parquet table in the shared checkpoint
    folder and read the table back.  ``run``: the folder of an earlier run to go on with."""
    run = run or f"{checkpoint_dir(spark).rstrip('/')}/docsift-stream/{name}-{uuid.uuid4().hex[:8]}"
    # keyed state with a time to live is RocksDB's; no batches without data, which would never end
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        q = (df.writeStream.format("parquet").option("path", f"{run}/out")
             .option("checkpointLocation", f"{run}/ckpt").outputMode("append")
             .trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{run}/out")
