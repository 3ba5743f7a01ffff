"""Getting this package to the Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once.

    Jobs whose tasks run Python call this first, so that it need not be installed on the
    workers. The archive is made on the driver and travels with the application; a package
    that itself came as an archive is there already.
    """
    context, package = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _shipped:
        return
    if os.path.isdir(package):
        target = os.path.join(tempfile.mkdtemp(prefix="shelfkin-"), "shelfkin")
        context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(package), "shelfkin"))
    _shipped.add(context.applicationId)
