"""Small state beside the tables: the shared folder, the last-run marker and settings."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the setting is absent and the session is local (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    given = "file://" + tempfile.mkdtemp(prefix="threadlens-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", given)
    return given


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run in here go when it ends: a written table replaces its lineage."""
    before = spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(_RELEASE, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows through a table of their own in the shared folder, so that several uses compute them once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_marker(path: str) -> datetime | None:
    """When the last report ran; None if it never did or the file cannot be read."""
    try:
        return datetime.fromisoformat(Path(path).read_text().strip())
    except (OSError, ValueError):
        return None


def write_marker(path: str, moment: datetime) -> None:
    """Replaced in one step, so that a reader sees the old or the new one."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    new = Path(f"{path}.new")
    new.write_text(moment.isoformat())
    os.replace(new, path)


def read_settings(path: str, defaults: dict) -> dict:
    """Settings over defaults; unknown keys and unreadable files are ignored."""
    try:
        data = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        data = {}
    return defaults | {k: v for k, v in data.items() if k in defaults} if isinstance(data, dict) else dict(defaults)


def write_settings(path: str, settings: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(settings, indent=2))
