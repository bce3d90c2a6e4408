"""Spark session and shared-folder helpers.

Local runs (tests, bench) get a session sized for ``local[N]``; on a cluster
the caller's session is used as is.  Lineage is cut only through
``spark.checkpoint.dir``, which is read from the session; ``build_session`` gives
a local session one where Spark's defaults don't (Spark can't set it later).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int | None = None,
                  app: str = "docsift") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    partitions = partitions or int(cpus)
    builder = SparkSession.builder.master(master)
    if not _default("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="docsift-ckpt-"))
    spark = (
        builder
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # small splits, so that a local run's few files give every core a part of the scan
        .config("spark.sql.files.maxPartitionBytes", os.environ.get("DOCSIFT_SPLIT_BYTES", "4m"))
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DOCSIFT_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _default(key: str) -> str | None:
    """What a running session or Spark's defaults files say of a setting."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active.conf.get(key, None)
    home = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME", ""), "conf")
    path = os.path.join(home, "spark-defaults.conf")
    if os.path.isfile(path):
        with open(path) as f:
            for line in f:
                name, _, value = line.strip().replace("=", " ", 1).partition(" ")
                if name == key:
                    return value.strip()
    return None


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("set spark.checkpoint.dir, before the session starts, to a folder that driver and executors share")
    return path


def save_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/docsift-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
