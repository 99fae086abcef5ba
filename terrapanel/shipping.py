"""The package itself as a file for the executors' Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for each application; Spark serves the file from the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="terrapanel-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # the file is served until the driver ends
    try:
        copy = shutil.copytree(package, os.path.join(folder, "code", os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(folder, "terrapanel_package"), "zip", os.path.dirname(copy)))
    finally:
        shutil.rmtree(os.path.join(folder, "code"), ignore_errors=True)
    _shipped.add(context.applicationId)
