"""The streaming learner against a sequential fold, its time to live, and streams over folder tables."""
import datetime as dt
import random
import time
import uuid
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F

from docsift.operators.learning import candidate_stats, gate_sightings, learn_patterns
from docsift.plans.stream_queries import stream_learner, stream_process
from docsift.session import checkpoint_dir
from docsift.sources.render import sightings
from docsift.streaming.pipeline import learner_stream, run_available_now

SIGHTINGS = "feature_type string, text string, confidence double, ts timestamp, seq long"
DAY0 = dt.datetime(2024, 1, 1)


def test_stream_learner_equals_batch(spark):
    streamed = {(r.feature_type, r.expression) for r in stream_learner(spark, SF).collect()}
    batch = {(r.feature_type, r.expression)
             for r in learn_patterns(candidate_stats(gate_sightings(sightings(spark, SF)))).collect()}
    assert streamed == batch and streamed


def test_stream_process_covers_every_document(spark):
    out = stream_process(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.count() == docs.count()
    assert out.filter(F.col("status") != "completed").count() == 0


def test_streams_read_folder_tables(spark, tmp_path):
    """A table that Spark wrote is a folder of part files."""
    for name in ("documents", "events"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert stream_process(spark, str(tmp_path)).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    one, folder = (Counter(map(tuple, stream_learner(spark, d).collect())) for d in (SF, str(tmp_path)))
    assert one == folder and one


def learn(spark, folder, run, idle_seconds):
    stream = spark.readStream.schema(SIGHTINGS).option("maxFilesPerTrigger", 1).parquet(folder)
    return run_available_now(learner_stream(stream, idle_seconds), "learner", spark, run)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SIGHTINGS).coalesce(1).write.mode("append").parquet(folder)


def test_learner_state_and_its_time_to_live(spark, tmp_path):
    folder = str(tmp_path / "in")

    def days(*at):
        return [("code", "AB-1", 0.9, DAY0 + dt.timedelta(days=d), d) for d in at]
    put(spark, folder, days(1, 0))
    kept, lost = (f"{checkpoint_dir(spark)}/test-learner-{uuid.uuid4().hex}" for _ in range(2))
    assert learn(spark, folder, kept, 3600).collect() == []
    assert learn(spark, folder, lost, 1).collect() == []
    time.sleep(2.5)
    put(spark, folder, days(2))
    # the third sighting: of a candidate that is still there, and of one that idled away unseen
    (got,) = learn(spark, folder, kept, 3600).collect()
    assert (got.occurrences, got.first_seen, got.last_seen) == (3, DAY0, DAY0 + dt.timedelta(days=2))
    assert learn(spark, folder, lost, 1).collect() == []


def test_learner_restarts_after_thirty_days(spark, tmp_path):
    at = [0, 5, 36, 37, 38, 39]  # 31 days pass between the second and the third
    put(spark, str(tmp_path / "in"), [("code", "AB-1", 0.9, DAY0 + dt.timedelta(days=d), d) for d in at])
    got = learn(spark, str(tmp_path / "in"), f"{checkpoint_dir(spark)}/test-learner-{uuid.uuid4().hex}", 3600).collect()
    assert [(r.occurrences, r.first_seen) for r in got] == [(3, DAY0 + dt.timedelta(days=36))]


def test_candidate_stats_is_a_sequential_fold(spark):
    """One key holds most rows, all at one time stamp; a key may be null."""
    rng = random.Random(3)
    rows = [("code", "hot", rng.random(), DAY0, i) for i in range(20_000)]
    rows += [(t, x, rng.random(), DAY0 + dt.timedelta(minutes=rng.randrange(50)), i)
             for i, (t, x) in enumerate((t, x) for t in ("code", None) for x in ("a", "b", None) for _ in range(7))]
    want = {}
    for t, x, c, ts, seq in sorted(rows, key=lambda r: (r[3], r[4])):
        n, ema, first, _ = want.get((t, x), (0, c, ts, ts))
        want[t, x] = (n + 1, ema * 0.7 + c * 0.3 if n else c, first, ts)
    rng.shuffle(rows)
    for runs in (1, 7, 64):
        got = candidate_stats(spark.createDataFrame(rows, SIGHTINGS).repartition(6), runs=runs).collect()
        assert {(r.feature_type, r.text): (r.occurrences, r.first_seen, r.last_seen) for r in got} == {
            k: (v[0], v[2], v[3]) for k, v in want.items()}
        for r in got:
            assert r.confidence == pytest.approx(want[r.feature_type, r.text][1], abs=1e-9)
    assert candidate_stats(spark.createDataFrame([], SIGHTINGS)).collect() == []


def test_a_hot_key_spans_many_runs(spark):
    rows = spark.range(200_000).select(F.lit("code").alias("feature_type"), F.lit("hot").alias("text"), F.lit(0.9).alias("confidence"),
                                       F.lit(DAY0).alias("ts"), F.col("id").alias("seq"))
    cut = rows.repartitionByRange(16, "feature_type", "text", "ts", "seq").groupBy(F.spark_partition_id()).count().collect()
    assert len(cut) == 16 and max(r["count"] for r in cut) < 3 * 200_000 / 16
