"""Pattern learning in batch: candidates, EMA confidence, maturity, generation.

Input rows are feature sightings ``(feature_type, text, confidence, ts, seq)``
from classified documents.  Steps:

* F6  drop sightings whose document confidence is below ``min_confidence``
* F7  value gate: length >= 3 and, for predefined types, the predefined regex
* A7  per (feature_type, text): occurrences, first/last seen, EMA confidence
      ``c <- 0.7 c + 0.3 x`` in arrival order, via its closed form (W5)
* H49 maturity: occurrences >= 3 and EMA >= 0.8
* H46-H48 expression: the predefined regex, else ``^re.escape(text)$`` validated
  (compiles, matches its text, not too permissive, 3..200 chars, rejects the
  negative probes)

Skew: one key, even one time stamp, may hold a large share of all sightings.  The
EMA is a scan: a run of consecutive sightings maps the value before it by
c -> a c + b, and such maps compose.  Sightings are cut into runs by a range
partitioning of (key, time, sequence), so a hot key spans many runs of like
size; each run is summed up for itself, and a key folds its few runs in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.fixed_values import (LEARNER_BASIC_PATTERNS, LEARNER_TOO_PERMISSIVE,
                                    PREDEFINED_FEATURE_REGEX)

RE_ESCAPE_CLASS = r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\u000b\u000c])"


def predefined_regex(feature_type: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in PREDEFINED_FEATURE_REGEX.items() for x in kv])
    return F.try_element_at(m, feature_type)


def gate_sightings(s: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """F6 + F7."""
    pre = predefined_regex(F.col("feature_type"))
    ok = (F.col("text").isNotNull() & (F.length("text") >= 3)
          & (pre.isNull() | F.coalesce(F.regexp_like(F.col("text"), pre), F.lit(False))))
    return s.filter(F.col("confidence") >= min_confidence).filter(ok)


def candidate_stats(s: DataFrame, keys: tuple[str, ...] = ("feature_type", "text"), runs: int | None = None) -> DataFrame:
    """A7 + W5 as a parallel ordered scan.  Output: keys, occurrences, first_seen, last_seen,
    confidence (EMA in (ts, seq) order).  ``runs``: of the range partitioning, at most that many
    runs a key (spark.sql.shuffle.partitions); keys may be null."""
    k = list(keys)
    runs = runs or int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = (s.select(*k, "ts", "seq", "confidence").repartitionByRange(runs, *k, "ts", "seq")
           .withColumn("_run", F.spark_partition_id()))
    # a run of a key is a part of one range, whatever the key's size
    inside = Window.partitionBy(*k, "_run")
    ranked = (cut.withColumn("_r", F.row_number().over(inside.orderBy("ts", "seq")))
              .withColumn("_n", F.count("*").over(inside)))
    weight = F.lit(0.3) * F.pow(F.lit(0.7), (F.col("_n") - F.col("_r")).cast("double"))
    each = ranked.groupBy(*k, "_run").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.max(F.when(F.col("_r") == 1, F.col("confidence"))).alias("x"), F.sum(F.col("confidence") * weight).alias("b"))
    ordered = each.groupBy(*k).agg(
        F.sum("n").alias("occurrences"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        F.sort_array(F.collect_list(F.struct("_run", "x", F.pow(F.lit(0.7), F.col("n").cast("double")).alias("a"), "b"))).alias("_runs"))
    # the first sighting counts whole: the value before it is taken to be the same
    ema = F.aggregate("_runs", F.col("_runs")[0]["x"], lambda c, r: r["a"] * c + r["b"])
    return ordered.select(*k, "occurrences", "first_seen", "last_seen", ema.alias("confidence"))


def re_escape(c: Column) -> Column:
    """Python ``re.escape`` (3.7+): backslash before each special character."""
    return F.regexp_replace(c, RE_ESCAPE_CLASS, "\\\\$1")


def generate_expression(feature_type: Column, text: Column) -> Column:
    """Predefined regex if the text matches it, else a validated literal pattern."""
    pre = predefined_regex(feature_type)
    lit_expr = F.concat(F.lit("^"), re_escape(text), F.lit("$"))
    probes = [F.lit(""), F.lit(" "), F.lit("a"), F.lit("." * 300), F.concat(text, F.lit("extra")),
              F.lit("invalid")]
    ok_literal = (F.regexp_like(text, lit_expr)
                  & ~lit_expr.isin(*LEARNER_TOO_PERMISSIVE)
                  & F.length(lit_expr).between(3, 200))
    for pr in probes:
        ok_literal = ok_literal & ((pr == text) | ~F.regexp_like(pr, lit_expr))
    basic = lit_expr.isin(*LEARNER_BASIC_PATTERNS)
    gen = F.when(basic | ok_literal, lit_expr)
    return F.when(pre.isNotNull(), F.when(F.regexp_like(text, pre), pre)).otherwise(gen)


def learn_patterns(stats: DataFrame, min_occurrences: int = 3, min_confidence: float = 0.8,
                   industry: Column | None = None) -> DataFrame:
    """Mature candidates -> one learned pattern per (industry, feature_type, expression).

    The EMA is compared at 9 decimals: a distributed sum has no fixed addition
    order, so the knife-edge ``0.7999999999999999`` of a sequential fold is not
    reproducible bit for bit."""
    mature = stats.filter((F.col("occurrences") >= min_occurrences)
                          & (F.round("confidence", 9) >= min_confidence))
    ind = industry if industry is not None else F.lit("general")
    out = mature.withColumn("expression", generate_expression(F.col("feature_type"), F.col("text"))) \
                .filter(F.col("expression").isNotNull()) \
                .withColumn("industry", F.coalesce(ind, F.lit("general")))
    return out.groupBy("industry", "feature_type", "expression").agg(
        F.count("*").alias("n_candidates"), F.sum("occurrences").alias("n_sightings"),
        F.sum(F.floor(F.col("occurrences") / min_occurrences)).alias("n_emissions"))


def stale_candidates(stats: DataFrame, now: Column, max_age_days: int = 30) -> DataFrame:
    """Whole days since last seen > max_age_days."""
    age_us = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    days = F.floor(age_us / 86_400_000_000)
    return stats.withColumn("age_days", days.cast("bigint")).withColumn("stale", F.col("age_days") > max_age_days)
