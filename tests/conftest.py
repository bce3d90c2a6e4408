import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from docsift.session import _default
    builder = SparkSession.builder.master("local[*]")
    if not _default("spark.checkpoint.dir"):                  # tests only: a scratch folder
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="docsift-test-"))
    s = (builder
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


SF = "/root/testdata/sf0.001"
