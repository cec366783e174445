"""Names and reading of the input tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session's executors, once."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessera-")  # executors may fetch it at any time
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(path := os.path.join(folder, "tessera_package.zip"), "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
