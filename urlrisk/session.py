"""Session helpers."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, name: str = "urlrisk", **extra: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Plans here have thousands of expressions; noting the call site of each one takes longer than planning them.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="urlrisk-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local-mode session without the setting gets a folder of its own; on a
    cluster a missing setting is an error, because a machine-local folder would
    be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _local_folder()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
