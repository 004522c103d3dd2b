"""Makes this package known to the Python workers of an application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from loomcube.storage import on_one_machine


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so that executors need no copy of it."""
    sc = spark.sparkContext
    if getattr(sc, "_loomcube_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if on_one_machine(spark):
        known = sc.environment.get("PYTHONPATH", "")
        sc.environment["PYTHONPATH"] = f"{package.parent}:{known}" if known else str(package.parent)
        sc._loomcube_shipped = True
        return
    target = Path(tempfile.mkdtemp(prefix="loomcube-")) / "loomcube.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, Path(package.name) / source.relative_to(package))
    sc.addPyFile(str(target))
    sc._loomcube_shipped = True
