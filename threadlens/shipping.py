"""Python workers import this package; where it is not installed on them it is sent along."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def installed() -> bool:
    """Whether workers find the package by themselves: on their path, or in the folder a local session runs in."""
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return ROOT in on_path or ROOT.name in ("site-packages", "dist-packages") or Path.cwd().resolve() == ROOT


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the session's workers, once, unless they have it."""
    if installed() or spark.conf.get("spark.threadlens.shipped", None):
        return
    folder = tempfile.mkdtemp(prefix="threadlens-")  # the driver serves the file from there as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/threadlens.zip", "w") as z:
        for f in sorted((ROOT / "threadlens").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(f"{folder}/threadlens.zip")
    spark.conf.set("spark.threadlens.shipped", "true")
