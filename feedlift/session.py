"""Session set-up for local runs, and the shared folder for written tables."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "feedlift", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster, spark-submit's own applies."""
    cores = os.cpu_count() if cpus == "*" else cpus
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _test_root() -> str:
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session, where driver and executors are one process, may fall
    back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _test_root()


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A folder name under the shared root that no earlier call has used."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
