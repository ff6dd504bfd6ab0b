"""Sending this package to the executors, so that their Python workers can import it wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application, add the package's sources as a zip file."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    name = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom.zip")
    with zipfile.ZipFile(name, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(name)
    _shipped.add(context.applicationId)
