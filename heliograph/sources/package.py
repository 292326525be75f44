"""This package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a session, for clusters where it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_heliograph_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    file = Path(tempfile.mkdtemp(prefix="heliograph-")) / "heliograph.zip"
    with zipfile.ZipFile(file, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(file))
    context._heliograph_shipped = True
