"""Make this package importable on the executors, where it isn't installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources along with the application, once, unless Python's path for the workers has it."""
    app = spark.sparkContext.applicationId
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or any(Path(p).resolve() == ROOT.parent for p in paths):
        return
    archive = Path(tempfile.mkdtemp(prefix="orrery-")) / "orrery_sources.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
