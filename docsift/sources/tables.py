"""Parquet table access with explicit column lists (so scans prune columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


#: Rows that one task is given where each row costs much work.
ROWS_PER_TASK = 50_000
#: The same for whole documents.
DOCUMENTS_PER_TASK = 5_000


def spread(df: DataFrame, rows: int, most: int = ROWS_PER_TASK) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt evenly to tasks of ``most`` rows, one for each core
    at least.  Small rows that cost much work (rendered, parsed, matched) would be left to a few
    tasks by splits and partitions of a size in bytes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)))
