"""Sending this package to Python workers, so that it need not be installed on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a session's context: the package's sources as a zip file that every executor fetches from the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_foliant_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    if package.is_dir():
        path = Path(tempfile.mkdtemp(prefix="foliant-")) / "foliant_sources.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(path))
    sc._foliant_shipped = True
