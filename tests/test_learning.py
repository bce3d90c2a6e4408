"""Learner: gates, EMA closed form vs fold, maturity, generation, staleness; A8 metrics."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from docsift.operators.learning import (candidate_stats, gate_sightings, generate_expression,
                                        learn_patterns, stale_candidates)
from docsift.operators.validation import confusion_metrics

SCHEMA = "feature_type string, text string, confidence double, ts timestamp, seq long"
T0 = dt.datetime(2024, 1, 1)


def fold(xs):
    c = None
    for x in xs:
        c = x if c is None else c * 0.7 + x * 0.3
    return c


def test_ema_matches_sequential_fold_across_buckets(spark):
    xs = [0.8, 1.0, 0.9, 0.85, 0.95, 0.82, 0.99]
    rows = [("ref", "REF-1", x, T0 + dt.timedelta(hours=5 * i), i) for i, x in enumerate(xs)]
    s = candidate_stats(spark.createDataFrame(rows, SCHEMA)).first()
    assert s.occurrences == len(xs) and s.confidence == pytest.approx(fold(xs), abs=1e-12)


def test_two_sightings_ema(spark):
    rows = [("ref", "REF-9", 0.8, T0, 1), ("ref", "REF-9", 1.0, T0 + dt.timedelta(seconds=1), 2)]
    s = candidate_stats(spark.createDataFrame(rows, SCHEMA)).first()
    assert s.occurrences == 2 and s.confidence == pytest.approx(0.86)


def test_gate_drops_low_confidence_and_bad_values(spark):
    rows = [("ref", "REF-1", 0.5, T0, 1), ("amount", "$1,000.00", 0.9, T0, 2), ("amount", "$100.00", 0.9, T0, 3),
            ("x", "ab", 0.9, T0, 4)]
    kept = [r.text for r in gate_sightings(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert kept == ["$100.00"]


def test_generation(spark):
    df = spark.createDataFrame([("invoice_number", "INV-2024-001"), ("amount", "$100.00"), ("date", "2024-03-15"),
                                ("date", "15/03/2024"), ("email", "invalid"), ("phone", "+1 (555) 123-4567")],
                               "feature_type string, text string")
    got = [r.e for r in df.select(generate_expression(F.col("feature_type"), F.col("text")).alias("e")).collect()]
    assert got[0] == r"^INV\-2024\-001$"
    assert got[1].startswith("^\\$?") and got[2] is not None and got[3] is not None
    assert got[4] is None and got[5] is not None


def test_learn_and_stale(spark):
    rows = [("ref", "REF-7", 0.9, T0 + dt.timedelta(hours=i), i) for i in range(4)]
    rows += [("ref", "OLD-1", 0.9, T0 - dt.timedelta(days=40), 10)]
    stats = candidate_stats(spark.createDataFrame(rows, SCHEMA))
    learned = learn_patterns(stats).collect()
    assert [(r.expression, r.n_emissions) for r in learned] == [(r"^REF\-7$", 1)]
    st = {r.text: r.stale for r in stale_candidates(stats, F.lit(T0 + dt.timedelta(days=1))).collect()}
    assert st == {"REF-7": False, "OLD-1": True}


def test_confusion_metrics(spark):
    m = confusion_metrics(F.lit(8), F.lit(2), F.lit(5), F.lit(0))
    r = spark.range(1).select(*[v.alias(k) for k, v in m.items()]).first()
    assert (r.precision, r.recall, r.f1) == (0.8, 1.0, 0.889)
    assert r.pattern_confidence == pytest.approx(round(0.8 * 0.4 + 1.0 * 0.4 + (16 / 18) * 0.2, 3))
    z = spark.range(1).select(confusion_metrics(F.lit(0), F.lit(0), F.lit(3), F.lit(0))["precision"]).first()[0]
    assert z == 0.0
