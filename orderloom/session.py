"""Session for tests and benchmarks, and the shared folder jobs write to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """Local session; on a cluster the submitted configuration applies instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orderloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    local_checkpoint_dir(session)
    return session


def checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session, which all executors must share."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        current = context.getConf().get("spark.checkpoint.dir")
        if current is None:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(current)
        current = context.getCheckpointDir()
    return current


def local_checkpoint_dir(spark: SparkSession) -> None:
    """Gives a local session that has no checkpoint folder one that ends with the process."""
    context = spark.sparkContext
    unset = context.getCheckpointDir() is None and context.getConf().get("spark.checkpoint.dir") is None
    if unset and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="orderloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """Fresh path in the shared folder, for one run's tables or stream checkpoints.

    It belongs to whoever asked for it, and lives as long as the shared folder does.
    """
    return f"{checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
