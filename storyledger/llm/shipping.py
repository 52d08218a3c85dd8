"""The library for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import storyledger

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to all present and future Python workers of the application, once.

    Spark serves the archive from the driver, so executors need no copy of the library on their path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(storyledger.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="storyledger-"), "storyledger.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("storyledger", os.path.relpath(path, root)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
