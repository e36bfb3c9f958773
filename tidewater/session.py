"""Sends this package to the executors, for Python tasks on machines that don't have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once for each SparkContext."""
    context = spark.sparkContext
    if getattr(context, "_tidewater_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / "tidewater.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))
    context._tidewater_shipped = True
