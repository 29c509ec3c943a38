"""Makes the package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Adds the package's sources to the application once, as a zip that Spark sends to every executor."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    context._tidemark_shipped = True
    root = Path(__file__).resolve().parents[1]
    if any(Path(p or ".").resolve() == root.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p):
        return  # workers inherit the driver's path
    target = Path(tempfile.mkdtemp()) / "tidemark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
