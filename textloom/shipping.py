"""Makes this package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once, unless their path holds it."""
    on_path = {os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)}
    if os.path.realpath(ROOT) in on_path or os.path.realpath(".") == os.path.realpath(ROOT):
        return
    sc = spark.sparkContext
    if getattr(sc, "_textloom_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "textloom").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(target)  # served by the driver, fetched by every executor
    sc._textloom_shipped = True
