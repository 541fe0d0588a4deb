"""Sending this package to the workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Spark send the package to all workers, once a context, so that their Python can import it."""
    context = spark.sparkContext
    if getattr(context, "_derivata_sent", False):
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="derivata-"), "derivata.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    context.addPyFile(str(path))
    context._derivata_sent = True
