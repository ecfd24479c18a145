"""A session with settings that suit the operators; callers may bring their own."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, name: str = "quillmill", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session to every operator."""
    shared = os.environ.get("QUILLMILL_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="quillmill-checkpoint-")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
