"""What a Spark session needs so that this package's tasks run in it."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_find_package(spark: SparkSession) -> SparkSession:
    """Puts this package's folder on the Python path of the workers; a cluster without that folder gets --py-files."""
    given = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in given.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{given}:{ROOT}".strip(":")
    return spark


def ready_for_checkpoints(spark: SparkSession) -> None:
    """The context gets the session's ``spark.checkpoint.dir``; only a local session that names none gets a temporary one.

    Checkpoints go when nothing refers to them any more, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def build(name: str = "speechmill", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings that the library's jobs are written for."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return workers_find_package(builder.getOrCreate())
