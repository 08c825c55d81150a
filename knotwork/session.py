"""Makes the package importable in Spark's Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once a session; the driver's file server hands it to executors, new ones too."""
    sc = spark.sparkContext
    if getattr(sc, "_knotwork_shipped", False):
        return
    root = Path(__file__).resolve().parent
    name = os.path.join(sc._temp_dir, "knotwork-package.zip")  # Spark's own folder, which goes with the session
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    sc._knotwork_shipped = True
