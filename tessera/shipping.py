"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED = "tessera.shipped"


def ship(spark: SparkSession) -> None:
    """Send the package to the workers unless their path has it already; once a session."""
    root = str(PACKAGE.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if spark.conf.get(_SHIPPED, None) == spark.sparkContext.applicationId:
        return
    archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)
