"""Make this package importable in Python workers on other machines."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="structlake-ship-")
    name = os.path.basename(_PACKAGE)
    copied = os.path.join(folder, "src", name)
    shutil.copytree(_PACKAGE, copied, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", os.path.join(folder, "src")))
    _shipped.add(app)
