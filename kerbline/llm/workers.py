"""Makes this package importable in the Python workers of every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import kerbline

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hands the package's sources to Spark, which copies them to the executors; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(kerbline.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="kerbline-ship-"), "kerbline.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    source = os.path.join(folder, name)
                    archive.write(source, os.path.relpath(source, os.path.dirname(top)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
