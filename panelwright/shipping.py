"""Give executors this package's modules, for the operators that run Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once an application."""
    context = spark.sparkContext
    if getattr(context, "_panelwright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="panelwright-")) / "panelwright_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, f"{root.name}/{file.relative_to(root)}")
    context.addPyFile(str(archive))
    context._panelwright_shipped = True
