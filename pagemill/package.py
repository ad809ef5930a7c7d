"""Sending this package to the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import the package, once an application; where PYTHONPATH names its folder they can already."""
    sc = spark.sparkContext
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in paths or sc.applicationId in _sent:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="pagemill-"))  # the driver's own; Spark serves the file to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "pagemill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((ROOT / "pagemill").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(archive))
    _sent.add(sc.applicationId)
