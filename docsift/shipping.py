"""Make the package importable in Python workers, wherever the job was started from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add this package to the job's Python files, once per application.

    Spark's own file distribution carries the archive to every executor, so Python
    functions import the package without a PYTHONPATH on the workers.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(root)
    path = os.path.join(tempfile.mkdtemp(prefix="docsift-ship-"), "docsift.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
