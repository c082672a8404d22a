"""Sends the package to executors that may not have it installed."""

from __future__ import annotations

import atexit
import hashlib
import io
import pathlib
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python path of all executors, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_primeweft_shipped", False):
        return
    top = pathlib.Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(top.parent))), p.read_bytes())
    name = f"primeweft-{hashlib.sha256(buffer.getvalue()).hexdigest()[:16]}.zip"
    folder = tempfile.mkdtemp(prefix="primeweft-zip-")
    atexit.register(shutil.rmtree, folder, True)
    (pathlib.Path(folder) / name).write_bytes(buffer.getvalue())
    sc.addPyFile(f"{folder}/{name}")
    sc._primeweft_shipped = True
