"""What a session needs before its Python workers can import this package."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable_on_workers(spark: SparkSession) -> None:
    """Python workers started from now on look for the package where the driver found it (no effect where it is installed)."""
    environment = spark.sparkContext.environment
    if ROOT not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [ROOT, environment.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where none is set and the session is local, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spanforge-"))
    return context.getCheckpointDir().rstrip("/")
