"""The package on the executors, as ``--py-files`` puts it there."""

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package to the executors once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        archive = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "pairloom")
        root, name = os.path.split(_PACKAGE)
        context.addPyFile(shutil.make_archive(archive, "zip", root, name))
        _shipped.add(context.applicationId)
