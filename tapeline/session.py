"""Session helpers: local test session and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, name: str = "tapeline") -> SparkSession:
    """Session for tests and the bench; on a cluster use the one you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TAPELINE_DRIVER_MEMORY", "12g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` when the cluster sets it.

    Only a session without that setting (tests, local runs) falls back to a temporary folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_run_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(spark: SparkSession, df):
    """Reliable checkpoint in the shared folder: later branches reuse it and survive lost executors."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def cut_partitioned(spark: SparkSession, df, keys: list[str], order: list[str]):
    """Checkpoint dealt by ``keys`` and sorted by ``order`` that still says so: windows and groups over the keys read it without a shuffle.

    The rows of a key have to fit a task (a series, a frame). The adaptive plan would hide the
    partitioning, so it is off while the checkpoint is written.
    """
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(spark, df.repartition(*keys).sortWithinPartitions(*order))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
