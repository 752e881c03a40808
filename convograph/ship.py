"""Sending the package to the Python workers of a cluster."""
from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Gives each worker the package through Spark's own file distribution, once a context; workers
    on other machines need no installation. The archive lies on the driver, which serves it."""
    sc = spark.sparkContext
    if getattr(sc, "_shipped", None) == str(HERE):
        return
    path = Path(tempfile.mkdtemp(prefix="package-")) / "convograph.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(HERE.rglob("*.py")):
            z.write(f, f.relative_to(HERE.parent))
    sc.addPyFile(str(path))
    sc._shipped = str(HERE)
