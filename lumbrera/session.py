"""Session settings shared by tests, the bench and stand-alone use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A UTC session with adaptive execution; reuses the running one if there is one."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName("lumbrera")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path where driver and executors share files: under spark.checkpoint.dir, or a temporary one in a session of one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumbrera-")
    return f"{found.rstrip('/')}/lumbrera/{what}-{uuid.uuid4().hex}"
