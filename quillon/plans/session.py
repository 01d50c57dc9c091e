"""Shipping the package to executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python path of the session's executors, once for an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parents[2]
    name = f"{tempfile.mkdtemp()}/quillon_package"
    context.addPyFile(shutil.make_archive(name, "zip", here, "quillon"))
    _SHIPPED.add(context.applicationId)
