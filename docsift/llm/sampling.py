"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the hash that decides whether a row is in a sample.
SPREAD = 1 << 30
#: Strata up to this number have their counts broadcast.
SMALL = 10_000


def bounded_sample(rows: DataFrame, stratum: str, per_stratum: int, total: int) -> DataFrame:
    """About ``per_stratum`` rows of each value of ``stratum`` (all, if fewer), and about ``total``
    at most, by a hash of doc_id: the same rows whatever the partitions.  ``rows`` holds ids and
    strata only; adds ``draw``, the hash.  The size is bounded, so the sample may be broadcast."""
    counts = rows.groupBy(F.col(stratum).alias("s_value")).agg(F.count("*").alias("s_rows"))
    strata = counts.count()
    each = min(per_stratum, total / max(1, strata))
    if strata <= SMALL:  # a join by hash would put all ids of a stratum into one task
        counts = F.broadcast(counts)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(SPREAD))
    return (rows.join(counts, F.col(stratum) == F.col("s_value"))
            .withColumn("draw", draw)
            .where(F.col("draw") * F.col("s_rows") / SPREAD < each)
            .drop("s_value", "s_rows"))


def one_text(drawn: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of ``keys``, with the text of smallest hash: an id that very many rows
    share gives one text to a sample, so that the sample stays bounded by its ids."""
    return drawn.groupBy(*keys).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
