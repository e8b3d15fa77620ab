"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "surfsphere", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A local session for tests, the CLI and the bench; on a cluster the caller brings its own."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage into the cluster's shared checkpoint folder, so that a lost executor costs nothing.

    The folder is the session's ``spark.checkpoint.dir``. Where none is set, a local session (tests) gets a
    temporary one; on a cluster that is an error, as the nodes share no such folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession, per_partition: int = 2) -> int:
    """Number of hash buckets for a bucketed kernel: follows the shuffle width the cluster is sized with."""
    return max(8, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))
