"""The pattern store as tables (S12-S14): import, upserts, deletions, validation counts.

Patterns lie in ``BUCKETS`` partitions by a hash of their id.  A batch of changes rewrites the
partitions that it touches (dynamic partition overwrite) and no others.  Every write is keyed
by its content or its batch id, so a batch that is applied twice leaves what one application
leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import save_table
from .configs import upsert_latest

BUCKETS = 64
PATTERN = ("type string, expression string, feature_type string, industry string, examples array<string>, "
           "confidence double, metadata map<string,string>")


def read_pattern_map(spark: SparkSession, path: str, fields: str = PATTERN) -> tuple[DataFrame, DataFrame]:
    """JSON files that each map pattern ids to patterns -> (patterns, rejected).

    ``rejected`` (path, pattern_id, value) are the entries that are no pattern of these fields or
    have no type, and whole files that hold no map.  One file is read by one task."""
    files = (spark.read.text(path, wholetext=True)
             .select(F.col("_metadata.file_path").alias("path"), "value", F.from_json("value", "map<string,string>").alias("m")))
    entries = files.select("path", F.explode(F.map_entries("m")).alias("e")).select(
        "path", F.col("e.key").alias("pattern_id"), F.col("e.value").alias("value"),
        F.from_json("e.value", fields + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("p"))
    good = F.col("p").isNotNull() & F.col("p._bad").isNull() & F.col("p.type").isNotNull()
    patterns = entries.filter(good).select("path", "pattern_id", "p.*").drop("_bad")
    rejected = (entries.filter(~good).select("path", "pattern_id", "value")
                .unionByName(files.filter(F.col("m").isNull()).select("path", F.lit(None).cast("string").alias("pattern_id"), "value")))
    return patterns, rejected


def _bucket() -> Column:
    return F.pmod(F.xxhash64("pattern_id"), F.lit(BUCKETS)).cast("int")


def _stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(schema).parquet(path)


def _rewrite(changes: DataFrame, path: str) -> None:
    """Write one row for each id of ``changes`` over what the store has of it."""
    spark = changes.sparkSession
    changes = save_table(changes.withColumn("bucket", _bucket()), "store-changes")
    touched = [r.bucket for r in changes.select("bucket").distinct().collect()]  # at most BUCKETS
    old, merged = _stored(spark, path, changes.schema), changes
    if old is not None:
        kept = old.filter(F.col("bucket").isin(touched)).join(changes.select("pattern_id"), "pattern_id", "left_anti")
        merged = kept.select(changes.columns).unionByName(changes)
        # a task that is lost while partitions are replaced must not read them again
        merged = save_table(merged, "store-merged")
    if touched:
        (merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(path))


def upsert_patterns(new: DataFrame, path: str, order_cols: list[str]) -> None:
    """New rows take the place of the stored ones of their ``pattern_id``, examples and all;
    of several new rows of an id the last by ``order_cols`` counts.  Rows without an id are ignored.
    All batches of a store have the same columns."""
    rows = new.filter(F.col("pattern_id").isNotNull()).withColumn("deleted", F.lit(False))
    _rewrite(upsert_latest(rows, ["pattern_id"], order_cols).drop("n_versions"), path)


def delete_patterns(ids: DataFrame, path: str) -> None:
    """The patterns of these ``pattern_id`` go; an id that isn't stored is no error."""
    spark = ids.sparkSession
    stored = spark.read.parquet(path)
    gone = stored.join(ids.select("pattern_id").distinct(), "pattern_id", "left_semi").drop("bucket")
    _rewrite(gone.withColumn("deleted", F.lit(True)), path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(~F.col("deleted")).drop("deleted", "bucket")


def append_counts(counts: DataFrame, path: str, batch_id: int) -> None:
    """Add a batch's validation counts (pattern_id and numbers)."""
    counts.write.mode("overwrite").parquet(f"{path}/batch={int(batch_id)}")


def count_totals(spark: SparkSession, path: str) -> DataFrame:
    """Each pattern's counts over all batches."""
    rows = spark.read.parquet(path)
    numbers = [c for c in rows.columns if c not in ("pattern_id", "batch")]
    return rows.groupBy("pattern_id").agg(*[F.sum(c).alias(c) for c in numbers])
