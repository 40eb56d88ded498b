"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once a session, where PYTHONPATH doesn't have them already."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_weftline_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline-sources.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((ROOT / "weftline").rglob("*.py")):
            out.write(source, source.relative_to(ROOT))
    context.addPyFile(str(archive))
    context._weftline_shipped = True
